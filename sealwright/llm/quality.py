"""Learned quality rules: a decision list grown by sequential covering, emitted as a Spark conditional expression.

Statistics are taken over whole texts. A text's words are ``[^\\x20\\x09-\\x0D]+``; null and empty texts have no word,
all their statistics are 0 and they fail the base rules (fewer than 50 words). Repeated rows and ties are judged row
by row, each alike. An empty table gives an empty result; without labels the list is empty and only the base rules act.
Input columns other than the key and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))

STATS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(n, T.LongType()) for n in ("n_lines", "n_distinct", "n_upper", "n_letters", "n_marks")]
)

#: Features that rules may test, as expressions over the statistics.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "marks_per_word": ("n_marks", "n_words"),
    "words": ("n_words", None),
}


def statistics(text: str | None) -> tuple:
    """The statistics of one whole text."""
    if not text:
        return (0,) * 10
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the blanks of the definition
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.split()] if b"\n" in raw else ([raw] if n else [])
    dup_lines = len(lines) - len(set(lines))
    repeat = 0
    if n >= 3:
        counts = Counter(zip(words, words[1:], words[2:]))
        if len(counts) < n - 2:
            marked = bytearray(n)
            for i, w in enumerate(zip(words, words[1:], words[2:])):
                if counts[w] > 1:
                    marked[i] = marked[i + 1] = marked[i + 2] = 1
            repeat = sum(marked)
    upper = len(raw) - len(raw.translate(None, UPPER))
    letters = len(raw) - len(raw.translate(None, LETTERS))
    marks = text.count("!") + text.count("?")
    return (n, chars, symbols, dup_lines, repeat, len(lines), len(set(words)), upper, letters, marks)


@F.pandas_udf(STATS)
def _statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics(x) for x in texts], columns=STATS.names, dtype="int64")


def with_statistics(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with a struct column ``out``; the function runs once a row, whatever reads the struct later."""
    return df.withColumn(out, _statistics.asNondeterministic()(F.col(text)))


def feature(name: str, stats: str) -> Column:
    top, bottom = FEATURES[name]
    top = F.col(f"{stats}.{top}").cast("double")
    return top if bottom is None else top / F.greatest(F.col(f"{stats}.{bottom}").cast("double"), F.lit(1.0))


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``feature >= t`` or ``feature < t`` tests; what it covers is rejected."""

    tests: tuple[tuple[str, bool, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, at in self.tests:
            out &= (x[name] >= at) if above else (x[name] < at)
        return out

    def column(self, stats: str) -> Column:
        out = F.lit(True)
        for name, above, at in self.tests:
            out = out & ((feature(name, stats) >= at) if above else (feature(name, stats) < at))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>=' if a else '<'} {t:.6g}" for n, a, t in self.tests)


@dataclass
class DecisionList:
    """Rules in order; the first that covers a text rejects it, a text that none covers is kept."""

    rules: list[Rule] = field(default_factory=list)

    def verdict(self, stats: str) -> Column:
        """An ordered CASE: the number of the first rule that covers the row, null if none does."""
        out = None
        for i, r in enumerate(self.rules):
            out = F.when(r.column(stats), F.lit(i)) if out is None else out.when(r.column(stats), F.lit(i))
        return F.lit(None).cast("int") if out is None else out.otherwise(F.lit(None).cast("int"))

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.zeros(len(next(iter(x.values()))), bool)
        for r in self.rules:
            out |= r.covers(x)
        return out


def _thresholds(values: np.ndarray, most: int = 64) -> np.ndarray:
    """Midpoints between neighbouring distinct values, at most ``most`` of them, evenly by rank."""
    v = np.unique(values)
    if len(v) < 2:
        return np.empty(0)
    mid = (v[1:] + v[:-1]) / 2
    return mid if len(mid) <= most else mid[np.linspace(0, len(mid) - 1, most).astype(int)]


def _grow(x: dict, bad: np.ndarray, cuts: dict, most_tests: int) -> Rule:
    """Add the test with the largest FOIL gain until no kept text is covered."""
    tests: list = []
    live = np.ones(len(bad), bool)
    while len(tests) < most_tests:
        p, n = (live & bad).sum(), (live & ~bad).sum()
        if not n or not p:
            break
        base, best = np.log2(p / (p + n)), (1e-9, None)
        for name in x:
            for at in cuts[name]:
                above = x[name] >= at
                for side, mask in ((True, above), (False, ~above)):
                    pp = (live & bad & mask).sum()
                    if pp:
                        nn = (live & ~bad & mask).sum()
                        gain = pp * (np.log2(pp / (pp + nn)) - base)
                        if gain > best[0] + 1e-12:
                            best = (gain, (name, side, float(at)))
        if best[1] is None:
            break
        tests.append(best[1])
        live &= Rule((best[1],)).covers(x)
    return Rule(tuple(tests))


def _prune(rule: Rule, x: dict, bad: np.ndarray) -> Rule:
    """Drop final tests while that does not lower (p - n) / (p + n) on held-back rows."""

    def worth(r: Rule) -> float:
        c = r.covers(x)
        p, n = (c & bad).sum(), (c & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    best, value = rule, worth(rule)
    for k in range(len(rule.tests) - 1, 0, -1):
        shorter = Rule(rule.tests[:k])
        if (w := worth(shorter)) > value:
            best, value = shorter, w
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, least_precision: float = 0.9, most_rules: int = 24, most_tests: int = 4, seed: int = 7) -> DecisionList:
    """Sequential covering: grow on two thirds, prune on one third, keep a rule only if it is precise on both.

    ``least_precision`` bounds how many good texts a rule may reject for those it rejects rightly.
    """
    out = DecisionList()
    if not len(bad):
        return out
    order = np.random.default_rng(seed).permutation(len(bad))
    part = np.zeros(len(bad), bool)
    part[order[: len(bad) // 3]] = True  # held back for pruning
    left = np.ones(len(bad), bool)
    while len(out.rules) < most_rules:
        g, h = left & ~part, left & part
        if not (bad & g).any():
            break
        gx, hx = {k: v[g] for k, v in x.items()}, {k: v[h] for k, v in x.items()}
        rule = _grow(gx, bad[g], {k: _thresholds(v) for k, v in gx.items()}, most_tests)
        if not rule.tests:
            break
        rule = _prune(rule, hx, bad[h])
        c = rule.covers(x) & left
        p, n = (c & bad).sum(), (c & ~bad).sum()
        if p < 2 or p / (p + n) < least_precision:
            break
        out.rules.append(rule)
        left &= ~c
    return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most_labelled: int = 6000, **kw) -> DecisionList:
    """Learn from at most ``most_labelled`` labelled documents, chosen by a hash of the key.

    A key with several labels counts as bad if any label is 0; of a repeated document one copy counts. The sample is
    the only thing that reaches the driver: ``most_labelled`` rows of ten counts each.
    """
    picked = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where("k is not null and y is not null").groupBy("k").agg(F.min("y").alias("y"))
    picked = picked.orderBy(F.xxhash64("k"), "k").limit(most_labelled)  # bounded, so it may be broadcast
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(picked), "k")
    rows = with_statistics(rows, "t", "s").groupBy("k", "y").agg(F.min("s").alias("s"))
    got = rows.select("k", "y", *[feature(n, "s").alias(n) for n in FEATURES]).toPandas().sort_values("k")
    return learn({n: got[n].to_numpy(float) for n in FEATURES}, (got["y"] == 0).to_numpy(bool), **kw)


def judge(docs: DataFrame, rules: DecisionList, text: str = "text", out: str = "__quality") -> DataFrame:
    """``docs`` with a struct ``out``: the statistics, base_failed, the rule that rejects (null if none) and kept."""
    stats, failed = f"{out}_stats", f"{out}_failed"
    n, repeat = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    base = (n < 50) | (100 * repeat > 50 * n)
    df = with_statistics(docs, text, stats).withColumn(failed, base)
    rule = rules.verdict(stats)
    kept = ~F.col(failed) & rule.isNull()
    return df.withColumn(out, F.struct(f"{stats}.*", F.col(failed).alias("base_failed"), rule.alias("rule"), kept.alias("kept"))).drop(stats, failed)
