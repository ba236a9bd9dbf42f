"""Cutting unspaced text into words: a lattice of known words with frozen costs, and its cheapest path.

Costs are learned from a table of spaced text: the negative logarithm of a word's share, in thousandths, as whole numbers,
so that every order of summation finds the same path. A run of characters is cut by dynamic programming over its places; a
character that no known word reaches is a word of its own at the cost of one not met. Of paths with the same cost that with
fewer words is taken, then the one whose last words are longer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .text import words

#: Known words, at most, that a model holds (it is broadcast: a few MB), and characters in one of them.
MOST_WORDS, MOST_CHARS = 200_000, 24
#: Characters that a lattice takes at a time, about (a text is never parted), and those of a piece that is cut by itself.
CHUNK_CHARS, LONG = 1 << 17, 4096
#: Characters of scripts that are written without blanks.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"


@dataclass(frozen=True)
class Costs:
    """Frozen costs of known words, and of a character that isn't in one."""

    known: dict[str, int]
    other: int

    @property
    def longest(self) -> int:
        return max(map(len, self.known), default=1)


def learned(spaced: DataFrame, text: str, cut: Callable[[Column], Column] = words, most: int = MOST_WORDS) -> Costs:
    """Costs from all words of a table, which are counted where they lie; the `most` frequent ones are known, ties in the
    order of words. Words of more than MOST_CHARS characters are not."""
    ship(spaced.sparkSession)
    counts = spaced.select(F.explode(cut(F.col(text))).alias("w")).where(F.length("w") > 0).groupBy("w").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = counts.where(F.length("w") <= MOST_CHARS).orderBy(F.desc("n"), "w").limit(most).collect()
    return Costs({r["w"]: cost(r["n"], total) for r in rows}, cost(0, total))


def cost(n: int, total: int) -> int:
    """Of a word met n times of `total`; one not met is a tenth as likely as one met once."""
    return round(1000 * -log((n or 0.1) / max(total, 1)))


def cheapest(run: str, costs: Costs) -> list[str]:
    """The words of the cheapest path through a run of characters."""
    known, longest, other = costs.known, costs.longest, costs.other
    best, back = [(0, 0)], [0]
    for i in range(1, len(run) + 1):
        found = None
        for k in range(min(i, longest), 0, -1):
            own = known.get(run[i - k : i])
            if own is None:
                if k > 1:
                    continue
                own = other
            c, n = best[i - k]
            # of equal ones the longest word is met first
            if found is None or (c + own, n + 1) < found[:2]:
                found = (c + own, n + 1, k)
        best.append(found[:2]), back.append(found[2])
    out, i = [], len(run)
    while i:
        out.append(run[i - back[i] : i])
        i -= back[i]
    return out[::-1]


class Lattice:
    """cheapest() for many runs at once, with the same words.

    Known words lie in a tree of prefixes, a sorted array for each level, which all places of all runs go down together. A
    place that no known word reaches over is on every path, so runs fall into short pieces there; the pieces' paths are
    found in step, place by place. Costs are whole numbers from 0.
    """

    def __init__(self, costs: Costs):
        self.costs = costs
        known = sorted(w for w in costs.known if w)
        own = np.array([costs.known[w] for w in known], np.int64)
        size = np.array([len(w) for w in known], np.int64)
        chars = _points("".join(known))
        self.alphabet = np.unique(chars)
        self.base = len(self.alphabet) + 1
        code = np.searchsorted(self.alphabet, chars) + 1
        first = np.cumsum(size) - size
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        node, of = np.zeros(len(known), np.int64), np.arange(len(known))
        for k in range(int(size.max(initial=0))):
            deep = size[of] > k
            of, node = of[deep], node[deep]
            keys, node = np.unique(node * self.base + code[first[of] + k], return_inverse=True)
            cost = np.full(len(keys), -1, np.int64)
            ends = size[of] == k + 1
            cost[node[ends]] = own[of[ends]]
            self.levels.append((keys, cost))
        self.most = max(int(own.max(initial=0)), costs.other)

    def _edges(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, cost) of the known words at all places, one of one character at each, and the longest at each."""
        n = len(code)
        single, longest = np.full(n, self.costs.other, np.int64), np.ones(n, np.int64)
        starts, lengths, costs = [], [], []
        alive, node = np.arange(n), np.zeros(n, np.int64)
        for k, (keys, cost) in enumerate(self.levels):
            inside = alive + k < n
            alive, node = alive[inside], node[inside]
            key = node * self.base + code[alive + k]
            node = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            there = keys[node] == key
            alive, node = alive[there], node[there]
            if not len(alive):
                break
            own = cost[node]
            at, own = alive[own >= 0], own[own >= 0]
            if k == 0:
                single[at] = own
            else:
                longest[at] = k + 1
                starts.append(at), lengths.append(np.full(len(at), k + 1)), costs.append(own)
        return np.concatenate([np.arange(n), *starts]), np.concatenate([np.ones(n, np.int64), *lengths]), np.concatenate([single, *costs]), longest

    def _ends(self, joined: str, stops: np.ndarray) -> np.ndarray:
        """Whether a word of a cheapest path ends before each place of a text; none reaches over the places of `stops`."""
        points = _points(joined)
        n, code = len(points), np.zeros(len(points), np.int64)
        if len(self.alphabet):
            at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
            code = np.where(self.alphabet[at] == points, at + 1, 0)
        code[stops] = 0
        start, length, cost, longest = self._edges(code)
        fresh = np.concatenate([[True], np.maximum.accumulate(np.arange(n) + longest)[:-1] <= np.arange(1, n)])
        begins = np.flatnonzero(fresh)
        sizes = np.diff(np.append(begins, n))
        mark = np.zeros(n + 1, bool)
        # a piece's cost and number of words share 63 bits
        most = min(LONG, (1 << 43) // (self.most + 1))
        for b, size in zip(begins[sizes > most], sizes[sizes > most]):
            mark[b + np.cumsum([len(w) for w in cheapest(joined[b : b + size], self.costs)])] = True
        piece = np.cumsum(fresh) - 1
        short = (sizes <= most)[piece[start]]
        start, length, cost = start[short], length[short], cost[short]
        end = start + length
        far = end - begins[piece[start]]
        order = np.argsort(far * (n + 1) + end, kind="stable")
        start, length, end, far = start[order], length[order], end[order], far[order]
        more, new = (cost[order] << 20) + 1, fresh[start]
        best, back = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        first = np.flatnonzero(np.concatenate([[True], (end[1:] != end[:-1]) | (far[1:] != far[:-1])])) if len(end) else np.zeros(0, np.int64)
        steps = np.concatenate([[0], np.flatnonzero(np.diff(far)) + 1, [len(far)]])
        groups = np.searchsorted(first, steps)
        for a, b, g, h in zip(steps[:-1], steps[1:], groups[:-1], groups[1:]):
            if a == b:
                continue
            v = np.where(new[a:b], 0, best[start[a:b]]) + more[a:b]
            at = first[g:h] - a
            least = np.minimum.reduceat(v, at)
            tied = v == np.repeat(least, np.diff(np.append(at, b - a)))
            to = end[first[g:h]]
            best[to], back[to] = least, np.maximum.reduceat(np.where(tied, length[a:b], 0), at)
        place, least = (begins + sizes)[sizes <= most], begins[sizes <= most]
        while len(place):
            mark[place] = True
            place = place - back[place]
            on = place > least
            place, least = place[on], least[on]
        return mark

    def _chunks(self, runs: list[str]) -> Iterator[tuple[int, int, str, np.ndarray, np.ndarray]]:
        """(first, last, text, stops, ends) of some runs at a time, which lie in a text before its `stops`, and _ends() of it."""
        at = 0
        while at < len(runs):
            to, size = at + 1, len(runs[at])
            while to < len(runs) and size + len(runs[to]) < CHUNK_CHARS:
                size += len(runs[to])
                to += 1
            joined = "\n".join(runs[at:to]) + "\n"
            stops = np.cumsum([len(r) + 1 for r in runs[at:to]]) - 1
            yield at, to, joined, stops, self._ends(joined, stops)
            at = to

    def parts(self, runs: list[str]) -> Iterator[list[list[str]]]:
        """cheapest() of each run, those of some runs at a time."""
        for _, _, joined, stops, mark in self._chunks(runs):
            out, begin, ends = [], 0, np.flatnonzero(mark)
            for stop, last in zip(stops.tolist(), np.searchsorted(ends, stops, "right").tolist()):
                own = ends[np.searchsorted(ends, begin, "right") : last].tolist()
                out.append([joined[i:j] for i, j in zip([begin, *own], own)])
                begin = stop + 1
            yield out

    def cut(self, runs: list[str]) -> list[list[str]]:
        """cheapest() of each run."""
        return [words for part in self.parts(runs) for words in part]

    def agreed(self, runs: list[str], sizes: list[np.ndarray]) -> np.ndarray:
        """A row for each run: ends of words of the `sizes` told, ends of those found, and how many are both. No word is made."""
        out = np.zeros((len(runs), 3), np.int64)
        for at, to, joined, stops, found in self._chunks(runs):
            begins = np.concatenate([[0], stops[:-1] + 1])
            told = np.zeros(len(joined) + 1, bool)
            for b, own in zip(begins.tolist(), sizes[at:to]):
                told[b + np.cumsum(own, dtype=np.int64)] = True
            for k, mark in enumerate((told, found, told & found)):
                below = np.cumsum(mark)
                out[at:to, k] = below[stops] - below[begins]
        return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def cutter(spark: SparkSession, costs: Costs) -> Callable[[Column], Column]:
    """A column function text -> words of all of it, which is taken as one run; null and empty text have none."""
    ship(spark)
    sent = spark.sparkContext.broadcast(Lattice(costs))

    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.string())
        for texts in batches:
            # words are Python's for some texts at a time only
            parts = [pa.array(p, kind) for p in sent.value.parts([t or "" for t in texts.to_pylist()])]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    return cut


def recut(rows: DataFrame, told: Column, costs: Costs) -> DataFrame:
    """rows with `ends`, `found_ends` and `hits` as agreement() gives them for the words `told` and the cheapest path through
    all of them without blanks; null where there are none. Found words are not made, nor sent."""
    ship(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(Lattice(costs))

    @F.pandas_udf("ends int, found_ends int, hits int")
    def compared(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, sizes in batches:
            there = sizes.notna().to_numpy()
            counts = sent.value.agreed(list(texts[there]), list(sizes[there]))
            out = pd.DataFrame(pd.NA, index=range(len(texts)), columns=["ends", "found_ends", "hits"], dtype="Int32")
            out.loc[there] = counts
            yield out

    both = rows.withColumn("__c", compared(F.array_join(told, ""), F.transform(told, F.length)))
    return both.withColumns({c: F.col(f"__c.{c}") for c in ("ends", "found_ends", "hits")}).drop("__c")


def analyser(spark: SparkSession, costs: Costs) -> Callable[[Column], Column]:
    """words() for text that mixes scripts: spaced words as they are, runs of unspaced scripts along their cheapest path."""
    cut = cutter(spark, costs)

    def analyse(text: Column) -> Column:
        low = F.lower(text)
        spaced = F.regexp_extract_all(low, F.lit(rf"[\p{{L}}\p{{N}}&&[^{UNSPACED}]]+"), F.lit(0))
        # runs are joined by blanks, which are in no known word, and so are words of their own that go again
        runs = F.array_join(F.regexp_extract_all(low, F.lit(f"[{UNSPACED}]+"), F.lit(0)), " ")
        return F.when(low.rlike(f"[{UNSPACED}]"), F.concat(spaced, F.filter(cut(runs), lambda w: w != " "))).otherwise(words(text))

    return analyse


def boundaries(text: str | None, parts: list[str]) -> set[int]:
    """Where words end in a text without blanks."""
    out, at = set(), 0
    for w in parts:
        at += len(w)
        out.add(at)
    return out


def agreement(rows: DataFrame, truth: Column, found: Column) -> DataFrame:
    """rows with `ends`, `found_ends` and `hits`: ends of words, as told and as found, over the same characters."""
    ship(rows.sparkSession)

    def ends(sizes) -> np.ndarray | None:
        return None if sizes is None else np.setdiff1d(np.cumsum(np.asarray(sizes, np.int64)), [0])

    @F.pandas_udf("ends int, found_ends int, hits int")
    def compared(told: pd.Series, cut: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(told.map(ends), cut.map(ends)):
            out.append((None if a is None else len(a), None if b is None else len(b), None if a is None or b is None else len(np.intersect1d(a, b, True))))
        return pd.DataFrame(out, columns=["ends", "found_ends", "hits"]).astype("Int32")

    both = rows.withColumn("__c", compared(F.transform(truth, F.length), F.transform(found, F.length)))
    return both.withColumns({c: F.col(f"__c.{c}") for c in ("ends", "found_ends", "hits")}).drop("__c")
