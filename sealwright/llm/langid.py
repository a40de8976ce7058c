"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is cut into phrases, each the longest match
from its place that occurs in the language's training text (a character that never occurs there is a phrase of its
own). The language with the fewest phrases for each letter wins; ties go to the smaller name.

Texts are compared lower-cased, every run of other characters than letters as one blank. Whole texts are parsed, and
phrases are those of the whole text. For parallel work a text is laid out in blocks of ``BLOCK`` characters, which are
all parsed side by side as if a phrase began with each block. A block whose predecessor ends inside a phrase is then
parsed again from that state, until the new parse begins a phrase where the old one did (they agree from there on); a
block that ends in another state than before sends its successor through once more. Few texts need more than ``ROUNDS``
such rounds (repeated phrases that never fall into step); these are then parsed on from their first block that is not
settled, so that no block is parsed again and again.

Every character of a language's training text has its transitions, whatever the script. Automata are kept as
displaced rows: a state is the offset of its row in two arrays that all rows share, so a language takes about 20 bytes
for each character of its training text (400 languages of 60,000 characters: some 500 MB a worker).

A text that is null or has no letter is ``und`` with score 0. The score is 1 minus the ratio of the winner's phrases
to the second's (1 for one language only): 0 for a tie, near 1 for a sure case. Repeated rows get equal results; an
empty table gives none; without any training text every text is ``und``. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_doc_batches

BLOCK = 512
#: Rounds over all blocks that are not settled, before texts are parsed on one by one.
ROUNDS = 3
#: Between pieces of training text: no character of any text.
GAP = 0x110000

GUESS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("letters", T.LongType())])


@lru_cache(maxsize=1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is a letter, and whether it is a letter or a mark that belongs to one."""
    kinds = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    letter = np.fromiter((k == "L" for k in kinds), bool, 0x110000)
    return letter, letter | np.fromiter((k == "M" for k in kinds), bool, 0x110000)


def codes(text: str) -> np.ndarray:
    """Code points of the normalised text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _kinds()[1][c]
    c = np.where(letter, c, 32)
    keep = letter.copy()
    if len(c):
        keep[1:] |= letter[:-1]  # the first blank after a letter
        keep[0] = letter[0]
    return c[keep]


def automaton(seq: np.ndarray) -> list[dict[int, int]]:
    """The transitions of each state of the suffix automaton of ``seq``; state 0 is the root."""
    link, length, goes = [-1], [0], [{}]
    last = 0
    for c in seq.tolist():
        cur = len(length)
        length.append(length[last] + 1)
        link.append(0)
        goes.append({})
        p = last
        while p != -1 and c not in goes[p]:
            goes[p][c] = cur
            p = link[p]
        if p != -1:
            q = goes[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                goes.append(goes[q].copy())
                while p != -1 and goes[p].get(c) == q:
                    goes[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return goes


class Rows:
    """Transitions (of codes from 1) as displaced rows: state s goes by code c to ``to[s + c]`` if ``owner[s + c] == s``.

    A state is named by the offset of its row; no two rows have the same offset, and no slot belongs to two rows.
    """

    def __init__(self, goes: list[dict[int, int]]):
        fan = np.fromiter(map(len, goes), np.int64, len(goes))
        most = max((max(g) for g in goes if g), default=1)
        base = np.zeros(len(goes), np.int64)
        size = int(fan.sum()) + len(goes) // 8 + 64
        used, taken = np.zeros(size + 2 * most + 2, bool), np.zeros(size + 2 * most + 2, bool)

        def room(n: int) -> None:
            nonlocal used, taken
            if n > len(used):
                more = np.zeros(max(n, len(used) * 5 // 4) - len(used), bool)
                used, taken = np.concatenate([used, more]), np.concatenate([taken, more])

        # rows of several transitions: the first offset at which all their slots are free, the widest rows first
        low, before = 1, 0
        for s in np.argsort(-fan, kind="stable").tolist():
            if fan[s] < 2:
                break
            if fan[s] != before:
                low, before = 1, int(fan[s])
            codes_ = list(goes[s])
            window = 256
            while True:
                room(low + window + most + 1)
                full = taken[low : low + window].copy()
                for c in codes_:
                    full |= used[low + c : low + c + window]
                at = int(full.argmin())
                if not full[at]:
                    break
                low += window
                window *= 2
            low += at
            base[s] = low
            taken[low] = True
            used[[low + c for c in codes_]] = True
        # rows of one transition fill the gaps, those of one character together
        single = np.flatnonzero(fan == 1)
        by = np.fromiter((next(iter(goes[s])) for s in single), np.int64, len(single))
        single = single[np.argsort(by, kind="stable")]
        kinds, n = np.unique(by, return_counts=True)
        ends = np.cumsum(n)
        for k in np.argsort(-n, kind="stable"):
            own, c = single[ends[k] - n[k] : ends[k]], int(kinds[k])
            while len(own):
                at = np.flatnonzero(~used[c + 1 :]) + 1
                at = at[~taken[at]][: len(own)]
                base[own[: len(at)]] = at
                taken[at] = used[at + c] = True
                own = own[len(at) :]
                if len(own):
                    room(len(used) + len(own))
        none = np.flatnonzero(fan == 0)
        room(len(taken) + len(none))
        at = np.flatnonzero(~taken[1:])[: len(none)] + 1
        base[none] = at
        taken[at] = True
        end = int(max(np.flatnonzero(taken)[-1], np.flatnonzero(used)[-1] if used.any() else 0)) + most + 1
        self.owner, self.to = np.zeros(end, np.int32), np.zeros(end, np.int32)
        start = np.repeat(base, fan)
        slot = start + np.fromiter((c for g in goes for c in g), np.int64, len(start))
        self.owner[slot] = start
        self.to[slot] = base[np.fromiter((t for g in goes for t in g.values()), np.int64, len(start))]
        self.root = int(base[0])


@dataclass(frozen=True)
class Model:
    """Pieces of training text of each language (bounded, see :func:`train`), by name."""

    texts: tuple[tuple[str, tuple[str, ...]], ...]

    @property
    def key(self) -> str:
        return hashlib.sha256(repr(self.texts).encode("utf-8", "surrogatepass")).hexdigest()


_built: dict[str, tuple] = {}


def table(pieces: tuple[str, ...]) -> tuple[np.ndarray, Rows]:
    """The code points that the pieces hold, sorted (the code of one is its place, from 1), and the automaton's rows."""
    parts = []
    for t in pieces:
        parts += [codes(t), np.array([GAP], np.uint32)]
    seq = np.concatenate(parts[:-1])
    seen = np.unique(seq)
    return seen, Rows(automaton(np.searchsorted(seen, seq) + 1))


def built(model: Model) -> tuple[list[str], np.ndarray, list[tuple[np.ndarray, Rows]]]:
    """Names, the number of each code point, and for each language the code of each number and the rows.

    Built once for each worker process.
    """
    if model.key not in _built:
        _built.clear()
        tables = [table(t) for _, t in model.texts]
        points = np.unique(np.concatenate([seen for seen, _ in tables]))
        points = points[points < GAP]
        number = np.zeros(0x110000, np.int32)  # 0: in no language's training text
        number[points] = np.arange(1, len(points) + 1)
        own = []
        for seen, rows in tables:
            code = np.zeros(len(points) + 1, np.int32)  # 0, no transition, for characters of other languages
            code[np.searchsorted(points, seen[seen < GAP]) + 1] = np.arange(1, (seen < GAP).sum() + 1)
            own.append((code, rows))
        _built[model.key] = ([k for k, _ in model.texts], number, own)
    return _built[model.key]


class Lanes:
    """Blocks of texts side by side, the longest first: a column each, a row for each character of a block."""

    def __init__(self, seqs: list[np.ndarray], block: int):
        size = np.array([len(s) for s in seqs], np.int64)
        blocks = (size + block - 1) // block
        owner = np.repeat(np.arange(len(seqs)), blocks)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        length = np.minimum(block, size[owner] - within * block)
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        after = np.append(np.where(owner[1:] == owner[:-1], place[1:], -1), -1) if len(owner) else place
        self.texts, self.owner, self.length, self.after, self.within = len(seqs), owner[order], length[order], after[order], within[order]
        self.steps = int(length.max(initial=0))
        flat = np.concatenate([*seqs, np.empty(0, np.int32)])
        start = ((np.cumsum(size) - size)[owner] + within * block)[order]
        self.at = np.empty((self.steps, len(owner)), np.int32)
        for i in range(self.steps):
            self.at[i] = flat.take(start + i, mode="clip")
        # blocks longer than each step
        self.live = np.searchsorted(-self.length, -np.arange(self.steps), side="left")


def phrases(lanes: Lanes, code: np.ndarray, rows: Rows) -> np.ndarray:
    """How many phrases each whole text takes."""
    n = len(lanes.owner)
    if not n:
        return np.zeros(lanes.texts, np.int64)
    at, owner, to, root = code.take(lanes.at), rows.owner, rows.to, rows.root
    state = np.full(n, root, np.int32)
    begins = np.zeros((lanes.steps + 1, n), bool)  # where phrases begin
    begins[0] = True

    def restart(c: np.ndarray) -> np.ndarray:
        i = c + root
        return np.where(owner.take(i) == root, to.take(i), root)  # the root again: a character never seen

    for step in range(lanes.steps):
        m = lanes.live[step]
        c, s = at[step, :m], state[:m]
        i = s + c
        nxt = to.take(i)
        broken = np.flatnonzero(owner.take(i) != s)
        if len(broken):
            begins[step, broken] = True
            nxt[broken] = first = restart(c.take(broken))
            begins[step + 1, broken[first == root]] = True
        state[:m] = nxt

    def move(step, cur: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One character on: the next states, and where the new parse agrees with the old one."""
        c = at[step, cur]
        i = s + c
        nxt = to.take(i)
        broken = owner.take(i) != s
        new = broken | (s == root)
        nxt[broken] = restart(c[broken])
        agreed = new & begins[step, cur]
        begins[step, cur] = new
        return nxt, agreed

    entered = np.full(n, root, np.int32)  # the state in which each block was entered
    before = np.flatnonzero(lanes.after >= 0)
    for _ in range(ROUNDS):
        before = before[state[before] != entered[lanes.after[before]]]
        cur, s = lanes.after[before], state[before]
        entered[cur] = s
        changed = []
        for step in range(lanes.steps + 1):
            done = lanes.length[cur] <= step
            if done.any():
                state[cur[done]] = s[done]
                changed.append(cur[done])
                cur, s = cur[~done], s[~done]
            if not len(cur):
                break
            nxt, agreed = move(step, cur, s)
            cur, s = cur[~agreed], nxt[~agreed]
        changed = np.concatenate([*changed, np.empty(0, np.int64)])
        before = changed[lanes.after[changed] >= 0]
    while True:
        before = np.flatnonzero(lanes.after >= 0)
        before = before[state[before] != entered[lanes.after[before]]]
        if not len(before):
            break
        # the first block of each text that is not settled, and on from there
        before = before[np.lexsort((lanes.within[before], lanes.owner[before]))]
        before = before[np.unique(lanes.owner[before], return_index=True)[1]]
        cur, s, step = lanes.after[before], state[before], np.zeros(len(before), np.int64)
        entered[cur] = s
        while len(cur):
            nxt, agreed = move(step, cur, s)
            cur, s, step = cur[~agreed], nxt[~agreed], step[~agreed] + 1
            done = step == lanes.length[cur]
            if done.any():
                state[cur[done]] = s[done]
                follow = np.where(done, lanes.after[cur], cur)
                go = ~done | ((follow >= 0) & (entered[follow] != s))
                cur, s, step = follow[go], s[go], np.where(done, 0, step)[go]
                entered[cur[step == 0]] = s[step == 0]
    begins[lanes.length, np.arange(n)] = False
    return np.bincount(lanes.owner, begins.sum(axis=0), lanes.texts).astype(np.int64)


def guess(model: Model, texts: list[str | None], block: int = BLOCK) -> list[tuple[str, float, int]]:
    """The language, score and letter count of each text."""
    seqs, letters = [], []
    for t in texts:
        c = codes(t) if t else np.empty(0, np.uint32)
        letters.append(int(_kinds()[0][c].sum()))
        seqs.append(c)
    if not model.texts:
        return [("und", 0.0, n) for n in letters]
    names, number, tables = built(model)
    lanes = Lanes([number[c] for c in seqs], block)
    counts = np.array([phrases(lanes, code, rows) for code, rows in tables])
    out = []
    for i, n in enumerate(letters):
        if not n:
            out.append(("und", 0.0, 0))
            continue
        order = np.argsort(counts[:, i], kind="stable")[:2]  # names are sorted
        score = 1.0 if len(order) == 1 else 1.0 - counts[order[0], i] / counts[order[1], i]
        out.append((names[order[0]], float(score), n))
    return out


def with_language(docs: DataFrame, model: Model, text: str = "text", out: str = "__lang") -> DataFrame:
    """``docs`` with a struct of the predicted language, its score and the number of letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training parameters

    def run(col: pd.Series) -> pd.DataFrame:
        texts, rows = col.tolist(), []
        for a, b in per_doc_batches(texts, 2_000_000):
            rows += guess(shared.value, texts[a:b])
        return pd.DataFrame(rows, columns=GUESS.names)

    return docs.withColumn(out, F.pandas_udf(run, GUESS).asNondeterministic()(F.col(text)))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", chars_per_lang: int = 60_000, docs_per_lang: int = 200, chars_in_all: int = 24_000_000) -> Model:
    """A model from a bounded sample of labelled rows; every label is learned.

    For each language ``docs_per_lang`` documents or up to twice as many are drawn by a hash of the key; each teaches a
    piece at a hash-chosen place of its whole text, so long that ``docs_per_lang`` of them (or all, if there are fewer)
    give ``chars_per_lang`` characters. Of very many labels each gets an equal share of ``chars_in_all``. Rows are
    counted first (no text is read for that), so that the sample is drawn by a hash threshold without sorting a
    language's rows in one place. The driver receives one row for each label and the sample.
    """
    counts = docs.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return Model(())
    own = max(1, min(chars_per_lang, chars_in_all // len(counts)))
    most = 2.0**64
    share = docs.sparkSession.createDataFrame([(r.l, min(1.0, 2.0 * docs_per_lang / r.n) * most - most / 2, -(-own // min(r.n, docs_per_lang))) for r in counts], "l string, below double, piece int")
    rows = docs.select(F.xxhash64(F.col(key).cast("string"), F.lit("sample")).alias("h"), F.xxhash64(F.col(key).cast("string"), F.lit("place")).alias("p"), F.col(text).alias("t"), F.col(lang).alias("l"))
    # one row for each label
    drawn = rows.where("l is not null and length(t) > 0").join(F.broadcast(share), "l").where(F.col("h") < F.col("below"))
    place = F.pmod(F.col("p"), F.greatest(F.length("t") - F.col("piece"), F.lit(0)) + 1).cast("int") + 1
    got = drawn.select("l", "h", F.substring(F.col("t"), place, F.col("piece")).alias("t")).toPandas().sort_values(["l", "h", "t"])
    texts = []
    for name, group in got.groupby("l", sort=True):
        pieces, left = [], own
        for t in group["t"].drop_duplicates():
            if left > 0 and len(codes(t)):
                pieces.append(t[:left])
                left -= len(t)
        if pieces and any(len(codes(t)) for t in pieces):
            texts.append((name, tuple(pieces)))
    return Model(tuple(texts))
