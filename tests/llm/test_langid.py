import numpy as np
from pyspark.sql import functions as F

from sealwright.llm import langid, queries
from tests import oracle


def plain(text: str, train: str) -> int:
    """Phrases of the longest matches in a whole text, by searching the training text itself."""
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in train:
            j += 1
        i = max(j - 1, i + 1)
        n += 1
    return n


def text_of(c) -> str:
    return "".join(map(chr, c))


def test_phrases_against_brute_force():
    """Whatever the block, phrases are those of whole texts; some texts repeat long passages of the training text."""
    r = np.random.default_rng(4)
    for width in (2, 3, 6, 300):
        train = r.integers(1, width, 300)
        rows = langid.Rows(langid.automaton(train))
        code = np.arange(width + 1, dtype=np.int32)
        seqs = [r.integers(0, width, k).astype(np.int32) for k in (0, 1, 5, 22, 23, 24, 46, 200)]
        seqs += [np.concatenate([seqs[6], train[20:180], seqs[7], train[5:290]]).astype(np.int32)]
        want = [plain(text_of(s + 97), text_of(train + 97)) for s in seqs]
        for block in (1, 2, 7, 23, 512):
            assert langid.phrases(langid.Lanes(seqs, block), code, rows).tolist() == want
    assert langid.phrases(langid.Lanes([], 4), code, rows).tolist() == []


def test_texts_that_never_fall_into_step(monkeypatch):
    """Repeated letters and words whose phrases and blocks have different lengths, in one pass after a few rounds."""
    train = "a" * 10 + "bab" + "ha ha ha b" + "abcabcabcab"
    alphabet = sorted(set(train) | {"x"})
    code = {c: i for i, c in enumerate(sorted(set(train)), 1)}
    rows = langid.Rows(langid.automaton(np.array([code[c] for c in train])))
    texts = ["a" * 997, "ha " * 300, "abc" * 333 + "x" + "a" * 50, "b", "", "ab" * 77, "a" * 31 + "ha " * 40 + "a" * 64]
    seqs = [np.array([code.get(c, 0) for c in t], np.int32) for t in texts]
    for rounds in (0, 1, 3):
        monkeypatch.setattr(langid, "ROUNDS", rounds)
        for block in (1, 7, 16, 512):
            assert langid.phrases(langid.Lanes(seqs, block), np.arange(len(alphabet) + 1, dtype=np.int32), rows).tolist() == [plain(t, train) for t in texts]


def test_rows_keep_every_transition():
    r = np.random.default_rng(9)
    for seq in (r.integers(1, 5, 2000), r.integers(1, 900, 3000), np.ones(50, int), np.empty(0, int)):
        goes = langid.automaton(seq)
        rows = langid.Rows(goes)
        todo, name = [0], {0: rows.root}
        while todo:
            s = todo.pop()
            for c, t in goes[s].items():
                assert rows.owner[name[s] + c] == name[s]
                if t not in name:
                    todo.append(t)
                assert name.setdefault(t, int(rows.to[name[s] + c])) == rows.to[name[s] + c]
            assert (rows.owner[name[s] + 1 : name[s] + 1 + 900] == name[s]).sum() == len(goes[s])
        assert len(name) == len(goes) == len(set(name.values()))


def plain_guess(model, text):
    t = text_of(langid.codes(text or ""))
    if not any(c.isalpha() for c in t):
        return "und", 0.0
    n = sorted((plain(t, "\x00".join(text_of(langid.codes(p)) for p in pieces)), name) for name, pieces in model.texts)
    return n[0][1], 1 - n[0][0] / n[1][0]


def test_whole_texts_against_plain(spark):
    docs = spark.read.parquet(f"{oracle.SMALL}/documents.parquet")
    model = langid.train(docs.where(~queries.held_out()), chars_per_lang=3000, docs_per_lang=20)
    texts = [r.text[:4000] if r.text else r.text for r in docs.orderBy("doc_id").limit(60).collect()]
    assert [g[:2] for g in langid.guess(model, texts, 64)] == [plain_guess(model, t) for t in texts]


def test_many_scripts():
    """Every character counts, however many scripts are learned: 12 scripts of 30 to 3,000 letters each."""
    r = np.random.default_rng(1)
    starts = {"ar": (0x627, 28), "bn": (0x995, 32), "el": (0x3B1, 24), "he": (0x5D0, 27), "hi": (0x915, 35), "hy": (0x561, 38), "ja": (0x3042, 70), "ka": (0x10D0, 33), "ko": (0xAC00, 2500), "ru": (0x430, 32), "th": (0xE01, 40), "zh": (0x4E00, 3000)}

    def say(lang, n):
        first, size = starts[lang]
        p = 1 / np.arange(1, size + 1)
        return " ".join("".join(chr(first + i) for i in r.choice(size, r.integers(1, 6), p=p / p.sum())) for _ in range(n))

    model = langid.Model(tuple((k, (say(k, 1500),)) for k in sorted(starts)))
    asked = [(k, say(k, n)) for k in starts for n in (12, 60, 400)]
    assert [g[0] for g in langid.guess(model, [t for _, t in asked])] == [k for k, _ in asked]
    for k, pieces in model.texts:
        assert langid.guess(model, list(pieces))[0][0] == k


def test_two_languages_of_one_large_script():
    r = np.random.default_rng(2)
    a, b = r.permutation(2000), r.permutation(2000)
    p = 1 / np.arange(1, 2001)
    say = lambda o, n: "".join(chr(0x4E00 + o[i]) for i in r.choice(2000, n, p=p / p.sum()))
    model = langid.Model((("a", (say(a, 20_000),)), ("b", (say(b, 20_000),))))
    asked = [say(o, 60) for o in (a, b) for _ in range(40)]
    assert [g[0] for g in langid.guess(model, asked)] == ["a"] * 40 + ["b"] * 40


def test_rows_are_small():
    text = np.random.default_rng(3).choice(np.arange(1, 41), 60_000, p=(w := 1 / np.arange(1, 41)) / w.sum())
    rows = langid.Rows(langid.automaton(text))
    assert rows.owner.nbytes + rows.to.nbytes < 24 * len(text)


def test_normalised_text():
    assert text_of(langid.codes("  Ab1cD\n\nÉ!! ")) == "ab cd é "
    assert len(langid.codes("")) == 0 and len(langid.codes("12 !")) == 0


MODEL = langid.Model((("x", ("the cat sat on the mat and the dog " * 20,)), ("y", ("le chat est sur le tapis et le chien " * 20,))))


def test_odd_rows(spark):
    rows = [None, "", "123 !!", "the dog", "le chien", "the dog", "the cat sat " * 30_000, "́", "漢字"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id int, text string").withColumn("lang", F.lit("clash")).withColumn("score", F.lit(2))
    got = [r["__lang"] for r in langid.with_language(df, MODEL).orderBy("doc_id").collect()]
    assert [g.lang for g in got] == ["und", "und", "und", "x", "y", "x", "x", "und", "x"]  # the last is a tie
    assert got[3] == got[5] and got[8].score == 0 and all(0 <= g.score <= 1 for g in got)
    assert langid.with_language(df.limit(0), MODEL).count() == 0
    none = langid.train(df.limit(0).select("doc_id", "text", F.lit("x").alias("lang")))
    assert none.texts == () and {r["__lang"].lang for r in langid.with_language(df, none).collect()} == {"und"}
    one = langid.Model(MODEL.texts[:1])
    assert langid.guess(one, ["the dog"]) == [("x", 1.0, 6)]


def test_training_is_bounded(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words here"), F.col("id")).alias("text"), F.when(F.col("id") % 9 == 0, "b").when(F.col("id") % 2 == 0, "a").alias("lang"))
    m = langid.train(df, chars_per_lang=40, docs_per_lang=10)
    assert [k for k, _ in m.texts] == ["a", "b"] and all(0 < sum(map(len, t)) <= 40 and len(t) > 5 for _, t in m.texts)


def test_every_label_is_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    df = spark.createDataFrame([(i, f"{letters[i % 26]}{letters[i // 26]} " * 9, f"l{i:03}") for i in range(600)], "doc_id int, text string, lang string")
    m = langid.train(df, chars_in_all=12_000)
    assert len(m.texts) == 600 and sum(len(p) for _, t in m.texts for p in t) <= 12_000


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op8_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 250 and (held.lang == held.lang_pred).mean() > 0.98


def test_query(spark):
    got = queries.op8_language_id(spark, oracle.SMALL)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert got.count() == spark.read.parquet(f"{oracle.SMALL}/documents.parquet").count()
    from zlib import crc32

    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.collect())
