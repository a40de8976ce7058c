import random

from pyspark.sql import functions as F

from sealwright.llm import licences, queries
from tests import oracle


def plain(text, threshold=licences.THRESHOLD, templates=licences.TEMPLATES):
    """Best licence id, its coefficient and the number of templates found, by trying every window."""
    if text is None:
        return None, None, 0
    g, found, kinds = licences.bigram_list(text), [], set()
    for k, (name, t) in enumerate(templates):
        own = licences.bigram_list(t)
        b = set(own)
        for p, x in enumerate(g):
            if x in b and (p == 0 or g[p - 1] not in b or x == own[0]):
                a = set(g[p : p + len(own)])
                dice = 2 * len(a & b) / (len(a) + len(b))
                if dice >= threshold - 1e-9:
                    found.append((-dice, name))
                    kinds.add(k)
    d, name = min(found, default=(None, None))
    return name, d and round(-d, 6), len(kinds)


def scan(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").withColumn("dice", F.lit("clash")).withColumn("licence_id", F.lit(0))
    out = licences.with_licence(df).orderBy("doc_id").select("__licence.*").collect()
    return [(r.licence_id, None if r.dice is None else round(r.dice, 6), r.n_matches) for r in out]


MIT = max((t for n, t in licences.TEMPLATES if n == "MIT"), key=len)
OPENING = sorted((t for n, t in licences.TEMPLATES if n == "MIT"), key=len)[-2]


def test_against_plain(spark):
    texts = [None, "", "\n\n", "nothing", "RELEASED under the MIT license", "x\nAll rights reserved.\nReleased under the MIT License.", MIT, MIT.replace(" ", "\n", 5), "intro\n\n" + MIT[:-60] + "\n\nend", MIT.replace("software", "program"), "word " * 60_000 + "\nLicensed under CC BY-NC 4.0.", "All rights reserved.\nAll rights reserved.", MIT + "\n" + MIT, "All rights"]
    r = random.Random(1)
    every = [w for _, t in licences.TEMPLATES for w in licences.words(t)]
    for _, t in licences.TEMPLATES:
        w = t.split(" ")
        for _ in range(2):  # some words replaced, other text around, words of other licences between
            x = [r.choice(every) if r.random() < 0.06 else y for y in w]
            texts.append(" ".join([*r.choices(every, k=r.randrange(30)), *x, *r.choices(every, k=r.randrange(30))]))
    assert scan(spark, texts) == [plain(t) for t in texts]
    assert scan(spark, []) == []


def test_embedded_notices(spark):
    """Every template is found inside a line, over lines of any width, and with some words before or after."""
    prose = " ".join(f"word{i}" for i in range(120))
    for change in (lambda t: f"{prose} {t} {prose}", lambda t: f"{prose}\n" + "\r\n * ".join(t.split(" ")) + f"\n{prose}", lambda t: f"Copyright 2020 Foo. {t} And so on."):
        got = scan(spark, [change(t) for _, t in licences.TEMPLATES])
        assert [g[1] for g in got] == [1.0] * len(got)
    lines = ["Copyright 2020 Foo. Licensed under the MIT License.", "Released under the MIT License. All rights reserved.", "This project is released under the MIT License."]
    assert [g[1] for g in scan(spark, lines)] == [1.0] * 3
    assert scan(spark, [f"{prose} {MIT[:-100]} {prose}"])[0][:2] == ("MIT", 1.0)  # the opening is whole


def test_templates_of_a_folder(spark, tmp_path):
    body = " ".join(f"clause{i % 700} term{i % 37} of" for i in range(2000))
    (tmp_path / "Long-1.0.txt").write_text(body)
    (tmp_path / "Short").write_text("use it as you like but do not sell it")
    templates = licences.read_templates(spark, str(tmp_path))
    assert [n for n, _ in templates] == ["Long-1.0", "Short"]
    texts = ["before " + body.replace("clause5 ", "section5 ") + " after", "You may USE it as you like, but do not sell it!", body[: len(body) // 2]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [tuple(r["__licence"]) for r in licences.with_licence(df, templates=templates).orderBy("doc_id").collect()]
    want = [plain(t, templates=templates) for t in texts]
    assert [(a, b and round(b, 6), n) for a, b, n in got] == want and [w[0] for w in want] == ["Long-1.0", "Short", None]


def test_query(spark):
    oracle.check(queries.op9_licence_scan(spark, oracle.SMALL), queries.oracle_sql()["op9_licence_scan"])


def test_native_plan(spark):
    plan = queries.op9_licence_scan(spark, oracle.SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
