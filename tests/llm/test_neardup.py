import random

import numpy as np
from pyspark.sql import functions as F

from sealwright.llm import neardup, queries
from tests import oracle


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_alignment_against_brute_force():
    r = np.random.default_rng(8)
    for n in [3, 5, 8, 20, 60, 150, 330] * 6:
        a = r.integers(0, 30, n).astype(np.uint32)
        b = a.copy()
        for _ in range(r.integers(0, n // 3 + 2)):
            i = r.integers(0, len(b) + 1)
            b = [np.insert(b, i, 99), np.delete(b, min(i, len(b) - 1)) if len(b) > 1 else b, np.concatenate([b[:i], [77], b[i + 1 :]]).astype(np.uint32)][r.integers(3)]
        d, m = distance(a.tolist(), b.tolist()), max(len(a), len(b))
        assert neardup.near(a, b.astype(np.uint32)) == (d <= int(0.2 * m + 1e-9)), (n, d, m)
        assert neardup._anchored(a, b.astype(np.uint32)) >= d
        for most in (1, 4, 16, 60):
            assert neardup._banded(a.astype(np.int64), b.astype(np.int64), most) == (d <= most)


def test_sketches_follow_order():
    words = [f"w{i}" for i in range(120)]
    h = lambda w: set(neardup.sketches(neardup.word_hashes(" ".join(w))).tolist())
    base = h(words)
    assert len(base) == neardup.SKETCHES
    assert len(base & h(words[:60] + ["x"] + words[61:])) >= 10
    swapped = words[60:] + words[:60]
    assert len(base & h(swapped)) <= 4  # the same k-mers in another order


def test_occurrences_are_labelled():
    w = neardup.word_hashes("a b c d e " * 4)
    assert len(set(neardup.kmers(w).tolist())) == len(w) - 4


def classes(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("bucket", F.lit(1)).withColumn("sketch", F.lit(2))
    return neardup.classes(df).select("doc_id", "class_id").collect()


def edited(r, words, n):
    out = list(words)
    for i in r.sample(range(len(out)), n):
        out[i] = f"e{r.randrange(10**6)}"
    return out


def test_groups(spark):
    r = random.Random(3)
    rows, want, i = [], {}, 0
    for g in range(12):
        base = [f"g{g}w{r.randrange(400)}" for _ in range(r.choice((30, 90, 300, 900)))]
        first = i
        for c in range(r.choice((1, 2, 6))):
            rows.append((i, " ".join(edited(r, base, len(base) // 40 * (c > 0)))))
            want[i], i = first, i + 1
        rows.append((i, " ".join(base).upper() + "."))  # the same words
        want[i], i = first, i + 1
    passage = " ".join(f"p{k}" for k in range(60))
    for _ in range(30):  # texts that share a passage are not copies
        rows.append((i, passage + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(120))))
        want[i], i = i, i + 1
    got = {x.doc_id: x.class_id for x in classes(spark, rows)}
    assert got == want


def test_a_chain_is_one_class(spark):
    r = random.Random(1)
    words, rows = [f"w{k}" for k in range(200)], []
    for i in range(12):
        rows.append((i, " ".join(words)))
        words = edited(r, words, 6)
    assert {x.class_id for x in classes(spark, rows)} == {0}


def test_odd_rows(spark):
    long = " ".join(f"w{i % 5000}" for i in range(20_000))
    rows = [(5, None), (6, ""), (7, " \n"), (5, None), (8, "!!! ???"), (9, "!!! ???"), (10, "one"), (11, "One"), (12, long), (13, long + " tail"), (None, "just some null id words here"), (None, "other words of a null id text"), (14, "just some null id words here"), (15, "a b c d"), (16, "a b c e")]
    got = sorted(((r.doc_id, r.class_id) for r in classes(spark, rows)), key=str)
    assert got == sorted([(5, 5), (5, 5), (6, 6), (7, 7), (8, 8), (9, 8), (10, 10), (11, 10), (12, 12), (13, 12), (None, 14), (None, None), (14, 14), (15, 15), (16, 16)], key=str)
    assert classes(spark, []) == []


def test_large_group(spark):
    r = random.Random(9)
    base = [f"b{k}" for k in range(150)]
    rows = [(i, " ".join(edited(r, base, 4))) for i in range(400)]
    assert {x.class_id for x in classes(spark, rows)} == {0}


def test_components(spark):
    r = random.Random(6)
    edges = [(f"{r.randrange(300):03}", f"{r.randrange(300):03}") for _ in range(200)] + [(f"x{i:03}", f"x{i + 1:03}") for i in range(60)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {n: root for n, root in neardup.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    linked = {n for e in edges if e[0] != e[1] for n in e}
    assert got == {n: find(n) for n in linked}


def plain_classes(docs):
    """({id: least id of its class}, links of a Jaccard similarity of 0.8) of {id: text}, by the exact edit distance of
    all pairs that share half of their k-mers."""
    words = {k: neardup.words(t) for k, t in docs.items()}
    kmers = {k: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] for k, w in words.items()}
    parent = {k: k for k in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sure = set()
    for a in docs:
        for b in docs:
            if a < b:
                x, y = kmers[a], kmers[b]
                j = len(set(x) & set(y)) / len(set(x) | set(y))
                if j >= 0.5 and distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9):
                    if j >= 0.8:
                        sure.add((a, b))
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {k: find(k) for k in docs}, sure


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{oracle.SMALL}/documents.parquet").collect()}
    want, sure = plain_classes(docs)
    got = {r.doc_id: r.class_id for r in queries.op10_order_minhash(spark, oracle.SMALL).collect()}
    assert set(got) == set(docs) and sure
    assert all(got[a] == got[b] for a, b in sure)
    assert all(want[k] == want[c] for k, c in got.items())  # no link that is none
    assert sum(got[k] == want[k] for k in docs) >= 0.98 * len(docs)


def test_shared_passages_are_not_compared(spark):
    """Texts of which less than 0.8 is a common passage make no pairs, those of which more is are one class."""
    r = random.Random(2)
    passage = " ".join(f"p{k}" for k in range(300))
    rows = [(i, passage + " " + " ".join(f"u{r.randrange(10**7)}" for _ in range(90 + i % 40))) for i in range(150)]
    rows += [(1000 + i, passage + " " + " ".join(f"u{r.randrange(10**7)}" for _ in range(20 + i % 30))) for i in range(150)]
    got = {x.doc_id: x.class_id for x in classes(spark, rows)}
    assert all(got[i] == i for i in range(150)) and {got[1000 + i] for i in range(150)} == {1000}
    nodes = spark.createDataFrame([(neardup._digest(w), neardup._digest(w), neardup.sequence(w).tobytes()) for w in (neardup.word_hashes(t) for _, t in rows[:150])], "node binary, root binary, seq binary")
    assert neardup._rare_pairs(nodes.select("node", "root"), nodes.select("node", "seq")).count() == 0


def test_short_pairs_at_the_limit():
    """Pairs of 5 to 50 k-mers with as many edits as a link allows share an entry: always up to ``SHORT`` k-mers."""
    r = random.Random(12)
    for n in range(5, 51):
        d, missed = n // 5, 0
        for t in range(40):
            a = [f"w{r.randrange(10**6)}" for _ in range(n + 4)]
            new = [f"e{r.randrange(10**6)}" for _ in range(d)]
            b = [a[:-d] + new, new + a[d:], a[:-d], a[d:]][t % 4]
            x, y = neardup.word_hashes(" ".join(a)), neardup.word_hashes(" ".join(b))
            assert neardup.near(neardup.sequence(x), neardup.sequence(y))
            missed += not set(neardup.sketches(x).tolist()) & set(neardup.sketches(y).tolist())
        assert missed == 0 if n <= neardup.SHORT else missed <= 2, (n, missed)


def test_short_copies(spark):
    a, b, c = ([f"{g}{k}" for k in range(10)] for g in "abc")
    rows = [(0, " ".join(a)), (1, " ".join(a[:9])), (2, " ".join(b[:9])), (3, " ".join(b[:8])), (4, " ".join(c)), (5, " ".join(c[:9] + ["x"]))]
    assert {x.doc_id: x.class_id for x in classes(spark, rows)} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_rare_pairs_hold_every_link(spark):
    """Texts made of common blocks, so that every k-mer is frequent: all links are among the pairs, and not all pairs."""
    r = random.Random(21)
    blocks = [[f"b{b}w{k}" for k in range(r.randrange(5, 40))] for b in range(12)]
    made = [[w for b in sorted(r.sample(range(12), r.randrange(5, 12))) for w in blocks[b]] for _ in range(70)]
    made += [edited(r, w, r.randrange(1, 8)) for w in made[:30]] + [w + w[:20] for w in made[:10]]
    hashes = {neardup._digest(h): h for h in (neardup.word_hashes(" ".join(w)) for w in made)}
    seqs = {k: neardup.sequence(h) for k, h in hashes.items()}
    nodes = spark.createDataFrame([(k, k, s.tobytes()) for k, s in seqs.items()], "node binary, root binary, seq binary")
    got = {(bytes(x.a), bytes(x.b)) for x in neardup._rare_pairs(nodes.select("node", "root"), nodes.select("node", "seq")).distinct().collect()}
    every = [(a, b) for a in seqs for b in seqs if a < b]
    links = {p for p in every if neardup.near(seqs[p[0]], seqs[p[1]])}
    assert links and links <= got and len(got) < len(every) / 2, (len(links), len(got), len(every))
