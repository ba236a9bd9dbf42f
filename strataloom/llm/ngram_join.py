"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents are sets of five-word shingles; equal sets are one class. MinHash bands deal classes to buckets; what shares
buckets, directly or through others, forms a candidate group. Inside a group, pairs are compared by MinHash values some at
a time and dropped once the posterior probability that their similarity reaches the threshold falls below a tolerance. At
first only MinHash values travel, to tell the classes that have a pair left; the shingles of these alone follow and verify
the pairs exactly. Groups are dealt as pairs of blocks that grow with the root of the group. Pairs never become rows: counts
of links and spanning stars leave a task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, hold, small
from .near_vectors import local_roots

WORDS, THRESHOLD = 5, 0.8
#: A pair of similarity 0.8 misses all bands with probability (1 - 0.8 ** 6) ** 32 = 6e-5.
BANDS, BAND_ROWS = 32, 6
HASHES = BANDS * BAND_ROWS
#: MinHash values compared before each look at the posterior, and the probability below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-7
#: Classes in one block of a candidate group: the larger of the first and the second times the root of the group's; and
#: shingles in one block, about.
BLOCK_DOCS, BLOCK_ROOT, BLOCK_SHINGLES = 256, 10, 4_000_000
#: Rows of a few numbers below which a table of documents' keys is broadcast, after a count.
KEYS = 200_000
#: Words whose hashes a worker keeps; beyond it the cache starts anew.
CACHE_WORDS = 400_000
SLICE_CHARS = 2_000_000

_WORD = re.compile(r"[^\W]+")
_RNG = np.random.default_rng(909)
_MULT = (_RNG.integers(0, 1 << 32, HASHES, np.uint64) | np.uint64(1)).astype(np.uint32)
_PLUS = _RNG.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)
_PLACE = _RNG.integers(0, 1 << 63, 64, np.uint64) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return h


_WORDS = _Hashes()


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct n-word shingles: words are lower-cased runs of letters, digits and `_`. A
    text of fewer words is one shingle; without a word there is none."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    if len(_WORDS) > CACHE_WORDS:
        _WORDS.clear()
    k = min(n, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        total = total + _mix(h[i : len(h) - k + 1 + i]) * _PLACE[i % 64]
    return np.unique(_mix(total))


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES values per set; empty sets get zeros."""
    out = np.zeros((len(sets), HASHES), np.uint32)
    begin = size = 0
    for i, s in enumerate(sets):
        size += len(s)
        if size >= 1 << 15 or i + 1 == len(sets):
            at = [j for j in range(begin, i + 1) if len(sets[j])]
            if at:
                flat = (np.concatenate([sets[j] for j in at]) >> np.uint64(32)).astype(np.uint32)
                first = np.cumsum([0] + [len(sets[j]) for j in at[:-1]])
                for k in range(HASHES):
                    out[at, k] = np.minimum.reduceat(flat * _MULT[k] + _PLUS[k], first)
            begin, size = i + 1, 0
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, matches below which a pair is dropped): with a uniform prior the similarity's posterior after m
    matches of n is Beta(m + 1, n - m + 1), which exceeds t with the probability that n + 1 draws of chance t give at most m."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while m < n:
            tail += comb(n + 1, m + 1) * threshold ** (m + 1) * (1 - threshold) ** (n - m)
            if tail >= tolerance:
                break
            m += 1
        out.append((n, m + 1))
    return out


def _signatures(batches: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    """(doc_id, text_hash, hi, lo, n, sign): a 128-bit hash of a text's shingles, their number and the lower halves of the
    MinHash values; a false match of two halves is as rare as 1 in 65536 and only lets a pair live longer."""
    import xxhash

    hold("ngram_join", _WORDS.clear)
    for pdf in batches:
        texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
        begin = chars = 0
        for i, text in enumerate(texts):
            chars += len(text)
            if chars >= SLICE_CHARS or i + 1 == len(texts):
                part = slice(begin, i + 1)
                sets = [shingles(t, words) for t in texts[part]]
                signs = minhashes(sets).astype("<u2")
                key = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), ">i8").reshape(-1, 2).astype(np.int64)
                n = np.array([len(s) for s in sets])
                yield pd.DataFrame(
                    {
                        "doc_id": pdf["doc_id"].array[part], "text_hash": pdf["text_hash"].array[part], "hi": key[:, 0], "lo": key[:, 1],
                        "n": n, "sign": [r.tobytes() if k else None for r, k in zip(signs, n)],
                    }
                )
                begin, chars = i + 1, 0


def _buckets(sign: Column) -> Column:
    """One key per band of a signature."""
    width = 2 * BAND_ROWS
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substr(sign, b * width + 1, F.lit(width))))


def candidates(
    signs: np.ndarray, size: np.ndarray, side: np.ndarray, threshold: float, tolerance: float, marked: np.ndarray | None = None
) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): pairs that sizes and MinHash values leave over, all pairs if there is one side, else those across the two.
    Given `marked`, sets that have a pair left are marked in it and pairs of two marked ones aren't looked at again."""
    looks = least_matches(threshold, tolerance)
    two = len(side) > 0 and side.min() != side.max()
    others = np.flatnonzero(side != side.min()) if two else None
    for i in np.flatnonzero(side == side.min()) if two else range(len(size)):
        js = others if two else np.arange(i + 1, len(size))
        if marked is not None and marked[i]:
            js = js[~marked[js]]
        low, high = np.minimum(size[js], size[i]), np.maximum(size[js], size[i])
        js = js[low >= threshold * high - 1e-9]
        matches, done = np.zeros(len(js), np.int64), 0
        for n, least in looks:
            if not len(js):
                break
            matches = matches + (signs[js, done:n] == signs[i, done:n]).sum(1)
            keep = matches >= least
            js, matches, done = js[keep], matches[keep], n
        if len(js):
            if marked is not None:
                marked[i] = marked[js] = True
            yield i, js


def compare(sets: list[np.ndarray], signs: np.ndarray, side: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of sets whose Jaccard similarity is `threshold` or more: all pairs if there is one side, else those
    across the two sides."""
    size = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(size) - size
    flag = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
    out_i, out_j = [], []
    for i, js in candidates(signs, size, side, threshold, tolerance):
        own = flat[first[i] : first[i] + size[i]]
        flag[own] = True
        lens = size[js]
        starts = np.cumsum(lens) - lens
        at = np.arange(int(lens.sum())) + np.repeat(first[js] - starts, lens)
        common = np.add.reduceat(flag[flat[at]].astype(np.int64), starts)
        flag[own] = False
        good = common / (size[i] + lens - common) >= threshold
        out_j.append(js[good]), out_i.append(np.full(int(good.sum()), i))
    return np.concatenate(out_i) if out_i else np.zeros(0, int), np.concatenate(out_j) if out_j else np.zeros(0, int)


def _signs(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(len(column), -1)


def _left_over(pdf: pd.DataFrame, threshold: float, tolerance: float) -> pd.DataFrame | None:
    """(grp, pair, fp) for the classes of two blocks that MinHash values leave a pair to."""
    marked = np.zeros(len(pdf), bool)
    for _ in candidates(_signs(pdf["sign"]), pdf["n"].to_numpy(), pdf["side"].to_numpy(), threshold, tolerance, marked):
        pass
    return pdf.loc[marked, ["grp", "pair", "fp"]] if marked.any() else None


def _links(pdf: pd.DataFrame, threshold: float, tolerance: float) -> pd.DataFrame | None:
    """(fp, linked, root) for the classes of two blocks that link."""
    sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
    i, j = compare(sets, _signs(pdf["sign"]), pdf["side"].to_numpy(), threshold, tolerance)
    if not len(i):
        return None
    fp, copies = pdf["fp"].to_numpy(), pdf["copies"].to_numpy()
    linked = np.bincount(i, copies[j], len(fp)) + np.bincount(j, copies[i], len(fp))
    own = np.unique(np.concatenate([i, j]))
    return pd.DataFrame({"fp": fp[own], "linked": linked[own].astype(np.int64), "root": fp[local_roots(i, j, len(fp))[own]]})


def _by_pair(rows: DataFrame, schema: str, task: Callable[[pd.DataFrame], pd.DataFrame | None]) -> DataFrame:
    """What `task` gives for each pair of blocks, from rows that are read in order of (group, pair). A pair of two blocks of
    which one is empty is left out: pairs inside the other belong to that block's pair with itself (`same`)."""

    def whole(held: list[pd.DataFrame]) -> pd.DataFrame | None:
        pdf = pd.concat(held, ignore_index=True)
        return task(pdf) if len(pdf) > 1 and (pdf["same"].iloc[0] or pdf["side"].nunique() > 1) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("ngram_join", _WORDS.clear)
        held: list[pd.DataFrame] = []
        mark = None
        for pdf in batches:
            grp, pair = pdf["grp"].to_numpy(), pdf["pair"].to_numpy()
            cuts = np.flatnonzero((grp[1:] != grp[:-1]) | (pair[1:] != pair[:-1])) + 1
            for at, to in zip([0, *cuts], [*cuts, len(pdf)]):
                if to > at and mark != (grp[at], pair[at]):
                    if held and (got := whole(held)) is not None:
                        yield got
                    held, mark = [], (grp[at], pair[at])
                held.append(pdf.iloc[at:to])
        if held and (got := whole(held)) is not None:
            yield got

    return rows.repartition("grp", "pair").sortWithinPartitions("grp", "pair", "side", "fp").mapInPandas(run, schema)


def _classes(signed: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(signed with `fp`, stored classes by fp). fp is a 64-bit hash of the 128-bit one; another is tried should two classes
    have got the same."""
    for salt in range(20):
        keyed = signed.withColumn("fp", F.when(F.col("n") > 0, F.xxhash64(F.lit(salt), "hi", "lo")))
        per_class = keyed.where("n > 0").groupBy("hi", "lo").agg(
            F.first("fp").alias("fp"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")).alias("rep"),
            F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sign").alias("sign"),
        )
        classes = scratch.keep(per_class.drop("hi", "lo"), "classes")
        n, keys = classes.agg(F.count("*"), F.count_distinct("fp")).first()
        if n == keys:
            return keyed, classes
        scratch.drop(classes)
    raise RuntimeError("no hash tells all classes apart")


def similar_documents(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    words: int = WORDS,
    tolerance: float = TOLERANCE,
    doc_id: str = "doc_id",
    text: str = "text",
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, class_id, class_hash, copies, n_links.

    class_id is the least doc_id among all documents that links of similarity >= threshold connect (class_hash tells rows
    of one id apart); copies the documents with the same shingles, itself included; n_links the other documents linked
    directly, copies included. Documents without a word, null or empty, link with nothing and are classes of their own.
    Texts of fewer than `words` words are one shingle. Very long texts are read whole; a task holds the shingles of two
    blocks, at least of two documents. Rows that repeat are copies. Other columns are not looked at. An empty table gives
    no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "ngram-join")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _signatures((b.assign(doc_id=b["doc_id"].astype("Int64")) for b in batches), words)

    signed = scratch.keep(rows.mapInPandas(sign, "doc_id long, text_hash long, hi long, lo long, n long, sign binary"), "signed")
    signed, classes = _classes(signed, scratch)
    dealt = classes.select("fp", F.explode(_buckets(F.col("sign"))).alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.min("fp").alias("m"), F.max("fp").alias("x")).where("m <> x").select("bucket", "m")
    met = dealt.join(shared, "bucket").where("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b"))
    groups = scratch.keep(connected_components(met, scratch), "groups")
    members = groups.select(F.col("node").alias("fp"), F.col("root").alias("grp")).join(classes, "fp")
    sizes = members.groupBy("grp").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    block = F.greatest(F.lit(float(BLOCK_DOCS)), BLOCK_ROOT * F.sqrt("docs"))
    blocks = F.greatest(F.ceil(F.col("docs") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    members = members.join(sizes.select("grp", blocks.cast("int").alias("blocks")), "grp")
    members = scratch.keep(members.withColumn("side", F.pmod(F.xxhash64("fp", "grp"), F.col("blocks")).cast("int")), "members")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = members.select("grp", "blocks", "side", "fp", "copies", "n", "sign", "rep", other.alias("other"))
    pair = (F.least("side", "other").cast("long") * F.col("blocks") + F.greatest("side", "other")).alias("pair")
    paired = paired.select("grp", pair, "side", (F.col("side") == F.col("other")).alias("same"), "fp", "copies", "n", "sign")
    left = _by_pair(paired, "grp long, pair long, fp long", lambda pdf: _left_over(pdf, threshold, tolerance))
    left = scratch.keep(left, "left")
    wanted = members.join(left.select("fp").distinct(), "fp", "left_semi")
    key = wanted.select("fp", F.col("rep.doc_id").alias("m_id"), F.col("rep.text_hash").alias("m_hash"))
    key = small(scratch.keep(key, "wanted"), KEYS)
    found = rows.join(key, rows["doc_id"].eqNullSafe(key["m_id"]) & (rows["text_hash"] == key["m_hash"])).select("fp", "text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("ngram_join", _WORDS.clear)
        for pdf in batches:
            yield pd.DataFrame({"fp": pdf["fp"], "shingles": [shingles(t, words).tobytes() for t in pdf["text"]]})

    # rows that repeat id and text give their class's shingles more than once
    sets = scratch.keep(found.mapInPandas(cut, "fp long, shingles binary").dropDuplicates(["fp"]), "shingles")
    verify = paired.join(left, ["grp", "pair", "fp"], "left_semi").drop("n").join(sets, "fp")
    stars = _by_pair(verify, "fp long, linked long, root long", lambda pdf: _links(pdf, threshold, tolerance))
    stars = scratch.keep(stars, "stars")
    scratch.drop(sets, members, left)
    linked = stars.groupBy("fp").agg(F.sum("linked").alias("linked"))
    roots = connected_components(stars.select(F.col("fp").alias("a"), F.col("root").alias("b")), scratch)
    per = classes.select("fp", "copies", "rep").join(linked, "fp", "left").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    per = scratch.keep(per.withColumn("root", F.coalesce("root", "fp")), "per-class")
    scratch.drop(classes)
    first = per.groupBy("root").agg(F.min("rep").alias("first"))
    per = per.join(first, "root").select("fp", "copies", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "first")
    out = signed.select("doc_id", "text_hash", "fp").join(per, "fp", "left")
    return out.select(
        "doc_id",
        "text_hash",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("first.text_hash", "text_hash").alias("class_hash"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scratch: Scratch | None = None, **how) -> DataFrame:
    """docs with one row of each class: that of the least doc_id; of rows that repeat id and text, one. Documents without
    a word all stay. Columns stay as they are. What goes is told to the documents, not what stays, as it is less."""
    scratch = scratch or Scratch(docs.sparkSession, "one-of-each")
    told = similar_documents(docs, doc_id=doc_id, text=text, scratch=scratch, **how)
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("text_hash").eqNullSafe(F.col("class_hash"))
    marks = told.where(F.col("copies") + F.col("n_links") > 1).groupBy("doc_id", "text_hash").agg(F.max(first).alias("__first"), F.count("*").alias("n"))
    marks = marks.where("not __first or n > 1").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__first")
    marks = small(scratch.keep(marks, "marks"), KEYS)
    hashed = docs.withColumn("__text", F.xxhash64(F.col(text).cast("string")))
    found = hashed.join(marks, hashed[doc_id].cast("long").eqNullSafe(marks["__id"]) & (hashed["__text"] == marks["__hash"]), "left")
    found = found.drop("__text", "__id", "__hash")
    alone = found.where("__first is null").drop("__first")
    repeated = found.where("__first").drop("__first").dropDuplicates([doc_id, text])
    return alone.unionByName(repeated)
