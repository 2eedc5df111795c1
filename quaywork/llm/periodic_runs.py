"""Runs of words that repeat with a period, by recompression.

The words of some texts, each text between marks that occur once, are compressed into a grammar: in turn, blocks of one
symbol become a symbol, and pairs of a left and a right symbol become one, until one symbol is left. How far two places
agree, to the right or to the left, is found by climbing the levels while both places are edges of nodes, and by
coming down where nodes differ: a step or two a level, for all pairs of places at once.

A run of period q is at least ``longest(q)`` words long, so it holds a place of the grid with step longest(q) - q
together with the place q words on. Each such pair of places with equal words is extended both ways; equal stretches
are one run, of their least period. A text's grids have n/2 * log n places together. A pair within a known run whose
period divides its distance would give that run again and is left out.

Texts without words, null texts and texts shorter than the shortest run have no runs. Rows are worked on one by one:
equal rows, null ids and ties are rows like others, an empty table gives no rows, and other columns are not read. A
text is never split: one text is one task's work, with about 100 bytes of memory for each of its words.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, FOLD = 24, 3
#: Words that are compressed together, and places that are extended together.
TOGETHER, PLACES = 200_000, 2_000_000
RUNS = "array<struct<start: long, length: long, period: long>>"


def longest(q: np.ndarray) -> np.ndarray:
    """The length that a run of period ``q`` has at least."""
    return np.maximum(LEAST, FOLD * q)


class Grammar:
    """A run-length grammar of a sequence whose first and last symbols occur once.

    Level 0 is the sequence. ``first[k]`` has, for each node of level k, the place of its first child in level k - 1,
    and at last the number of children; ``parent[k]`` is the way back from level k to k + 1. Nodes of one level have
    equal symbols where they stand for equal words.
    """

    def __init__(self, ids: np.ndarray):
        self.symbols, self.first, self.parent, self.pairs = [ids.astype(np.int32)], [None], [], [False]
        while len(self.symbols[-1]) > 1:
            s = self.symbols[-1]
            first = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1])
            if len(first) < len(s):
                size = np.diff(np.append(first, len(s)))
                self._add(first, s[first] * np.int64(size.max() + 1) + size, False)
                s = self.symbols[-1]
            if len(s) > 1:
                left = self._left(s)
                joined = left[s[:-1]] & ~left[s[1:]]
                first = np.concatenate([[0], np.flatnonzero(~joined) + 1])
                two = np.append(joined, False)[first]
                top = np.int64(s.max()) + 1
                code = s[first].astype(np.int64)
                code[two] = top * (code[two] + 1) + s[first[two] + 1]
                self._add(first, code, True)

    def _left(self, s: np.ndarray) -> np.ndarray:
        """Which symbols are left ones: the draw that makes most pairs, or only the first symbol where none makes any."""
        best, most = np.arange(s.max() + 1) == s[0], 0
        rng = np.random.default_rng(len(self.symbols))
        for _ in range(3):
            draw = rng.integers(0, 2, len(best), np.int8).astype(bool)
            n = np.count_nonzero(draw[s[:-1]] & ~draw[s[1:]])
            if n > most:
                best, most = draw, n
        return best

    def _add(self, first: np.ndarray, code: np.ndarray, pairs: bool) -> None:
        n = len(self.symbols[-1])
        first = np.append(first, n).astype(np.int32)
        self.parent.append(np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first)))
        self.symbols.append(np.unique(code, return_inverse=True)[1].astype(np.int32))
        self.first.append(first)
        self.pairs.append(pairs)

    def agree(self, i: np.ndarray, j: np.ndarray, right: bool = True) -> np.ndarray:
        """How many symbols agree from places ``i`` and ``j`` on, to the right or to the left; i < j."""
        one = 1 if right else -1
        stopped, at = [], np.arange(len(i))
        x, y = i.astype(np.int32), j.astype(np.int32)
        for k, s in enumerate(self.symbols):
            if not len(at):
                break
            up, first = self.parent[k], self.first[k + 1]
            left = [first[up[v] + 1] - v if right else v - first[up[v]] + 1 for v in (x, y)]  # symbols to the node's end
            whole = [first[up[v] + 1] - first[up[v]] for v in (x, y)]
            inside = (left[0] < whole[0]) | (left[1] < whole[1])
            differ = s[x] != s[y]
            step = np.where(inside & ~differ, np.minimum(*left), 0) * one
            x, y = x + step, y + step
            stop = inside & (differ | (left[0] != left[1]))
            stopped.append((at[stop], x[stop], y[stop]))
            at, x, y = at[~stop], up[x[~stop]], up[y[~stop]]
        assert not len(at), "two places of one sequence differ below its root"
        out = np.empty(len(i), np.int64)
        at, x, y = stopped.pop()
        for k in range(len(stopped), 0, -1):
            s, first = self.symbols[k - 1], self.first[k]
            size = np.minimum(first[x + 1] - first[x], first[y + 1] - first[y])
            x, y = (first[x], first[y]) if right else (first[x + 1] - 1, first[y + 1] - 1)
            step = np.where(s[x] == s[y], 1 if self.pairs[k] else size, 0) * one
            more = stopped.pop()
            at, x, y = np.concatenate([at, more[0]]), np.concatenate([x + step, more[1]]), np.concatenate([y + step, more[2]])
        out[at] = np.abs(x.astype(np.int64) - i[at])
        return out


def _grid(n: np.ndarray, begin: np.ndarray, lo: int, hi: int):
    """Blocks of (place, period) of the grids of texts of ``n`` words, for periods from ``lo`` to below ``hi``."""
    periods = np.maximum(np.minimum(n // FOLD, hi - 1) - lo + 1, 0)
    ends = np.cumsum(periods)
    total, at = int(ends[-1]) if len(ends) else 0, 0
    while at < total:
        k = np.arange(at, min(total, at + PLACES // 8))
        text = np.searchsorted(ends, k, "right")
        q = lo + k - (ends[text] - periods[text])
        step = longest(q) - q
        places = -(-(n[text] - q) // step)
        cut = max(1, int(np.searchsorted(np.cumsum(places), PLACES)))
        text, q, step, places = text[:cut], q[:cut], step[:cut], places[:cut]
        which = np.repeat(np.arange(len(places)), places)
        within = np.arange(len(which)) - np.repeat(np.cumsum(places) - places, places)
        yield begin[text[which]] + within * step[which], q[which]
        at += len(q)


def runs_of(ids: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs, by start and period: ``ids`` holds texts of ``n`` words from ``begin`` on, each
    between symbols that occur once."""
    found = np.empty((0, 3), np.int64)
    grammar, lo = None, 1
    while lo <= (n.max() // FOLD if len(n) else 0):
        hi = lo * 8
        reach = np.maximum.accumulate(found[:, 1]) if len(found) else None
        new = [found]
        for i, q in _grid(n, begin, lo, hi):
            same = ids[i] == ids[i + q]
            i, q = i[same], q[same]
            if len(found):  # the run that reaches farthest of those that start before a place
                k = np.searchsorted(found[:, 0], i, "right") - 1
                of = np.searchsorted(reach, reach[np.maximum(k, 0)])
                known = (k >= 0) & (i + q < found[of, 1]) & (q % found[of, 2] == 0)
                i, q = i[~known], q[~known]
            if not len(i):
                continue
            grammar = grammar or Grammar(ids)
            start = i - grammar.agree(i - 1, i + q - 1, right=False)
            end = i + q + grammar.agree(i, i + q)
            long = end - start >= longest(q)
            new.append(np.unique(np.stack([start[long], end[long], q[long]], 1), axis=0))
        every = np.concatenate(new)
        every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
        if len(every):  # one stretch has one least period
            every = every[np.concatenate([[True], (every[1:, :2] != every[:-1, :2]).any(1)])]
        found, lo = every[np.lexsort((every[:, 2], every[:, 0]))], hi
    return found


def _texts(batch: pa.RecordBatch):
    """Groups of (row, words) that hold about ``TOGETHER`` words, or one longer text."""
    held, n = [], 0
    for row, text in enumerate(batch.column(1)):
        words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
        if n and n + len(words) > TOGETHER:
            yield held
            held, n = [], 0
        held.append((row, words))
        n += len(words)
    if held:
        yield held


def _one_by_one(batch: pa.RecordBatch):
    for held in _texts(batch):
        number = defaultdict(count().__next__)
        n = np.array([len(w) for _, w in held], np.int64)
        begin = np.cumsum(n + 1) - n
        ids = np.empty(int((n + 1).sum()) + 1, np.int64)
        marks = np.append(begin - 1, len(ids) - 1)
        for (_, words), b in zip(held, begin.tolist(), strict=True):
            ids[b : b + len(words)] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        ids[marks] = len(number) + np.arange(len(marks))
        long = n >= LEAST
        runs = runs_of(ids, begin[long], n[long])
        over = np.zeros(len(ids) + 1, np.int64)
        np.add.at(over, runs[:, 0] + runs[:, 2], 1)
        np.add.at(over, runs[:, 1], -1)
        kept = np.cumsum(over)[:-1] == 0
        edges = np.searchsorted(runs[:, 0], np.append(begin, len(ids)))
        for k, (row, words) in enumerate(held):
            b, own = int(begin[k]), runs[edges[k] : edges[k + 1]]
            if len(own):
                words = [w for w, y in zip(words, kept[b : b + len(words)].tolist(), strict=True) if y]
            yield row, int(n[k]), [{"start": s - b, "length": e - s, "period": q} for s, e, q in own.tolist()], b" ".join(words)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) of each row: the runs of its words by start and period, and the text without what
    repeats: every word goes that lies in a run after the run's first period; the others are joined by spaces.

    A run is a stretch of words with least period q, ``longest(q)`` words long at least, that no neighbouring word
    extends. Words are what stands between spaces, tabs and line ends (x20, x09 to x0D).
    """
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_words long, runs {RUNS}, collapsed string"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, n, runs, left = zip(*_one_by_one(batch), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(left, pa.binary()).cast(pa.string(), safe=False)], names=[id_col, "n_words", "runs", "collapsed"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def plant(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where, in one of ten documents by the checksum of the id, the words from some place on repeat the
    first few of them, joined by spaces; the others are as they were."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    d = docs.select("doc_id", "text", g.alias("_g"), words.alias("_w")).withColumn("_n", F.size("_w").cast("long"))
    d = d.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    d = d.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)).cast("long"))
    whole = lambda c: c.cast("int")
    tail = F.flatten(F.array_repeat(F.slice("_w", whole(F.col("_a") + 1), whole(F.col("_p"))), whole(F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")))))
    made = F.slice(F.concat(F.slice("_w", F.lit(1), whole(F.col("_a"))), tail), F.lit(1), whole(F.col("_n")))
    return d.select("doc_id", F.when(F.col("_n") > 0, F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def strongest(runs: Column) -> Column:
    """The run of the greatest length over period, compared exactly; of equal ones the first."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    more = lambda a, x: a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"])
    return F.aggregate(runs, none, lambda a, x: F.when(more(a, x), x).otherwise(a))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``find_runs``."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = found.withColumn("_b", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_b.start").alias("start"), F.col("_b.length").alias("length"), F.col("_b.period").alias("period"),
        F.expr("1000 * _b.length div _b.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
