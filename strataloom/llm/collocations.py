"""Phrase collocations: counted n-grams per language, scored by their weakest cut.

All n-grams of 1 to max_words words become rows, level by level: words first, then pairs, then longer ones. What is counted
is summed per slice of text, per task and at last per language. As no n-gram is more frequent than the shorter ones in it,
an n-gram is exploded only if both (n-1)-grams in it fall on a bit of those that are frequent: a hashed bit map of fixed
size, which lets some rare ones through (they are counted and left out) and holds no frequent one back. Without it, the rows
of rare triples alone would take many times the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, hold
from .grams import cut, gram_hashes, slices

MAX_WORDS, LEAST, SHARE, MOST = 3, 10, 50, 2000
GAPS, STOPS = b" \t", b".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"
#: Bits of the map of frequent n-grams (16 MB), whatever the input's size, and bits in one row of it on its way to the driver.
MAP_BITS, PART_BITS = 1 << 27, 1 << 18
#: Tasks in which a language's best are looked for first.
SALTS = 64


def _seeds(langs: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(x.encode()) for x in langs), np.uint64, len(langs))


def _counted(lang: np.ndarray, ids: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(one place of each distinct (lang, ids...), how often it is there)."""
    key = lang.astype(np.int64)
    for i, own in enumerate(ids):
        if i and len(key) and int(key.max() + 1) * size >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * size + own
    _, at, n = np.unique(key, return_index=True, return_counts=True)
    return at, n


def _grams(batches: Iterator[pa.RecordBatch], n: int, frequent) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n): counts of the n-grams in slices of texts; with n = 1 also rows without a phrase, which count all
    words of a language."""
    hold("collocations", lambda: None)
    for batch in batches:
        langs, texts = batch.column("lang").dictionary_encode(), batch.column("text")
        names = [x or "" for x in langs.dictionary.to_pylist()]
        code, seeds = langs.indices.to_numpy(zero_copy_only=False), _seeds(names)
        for begin, end in slices(texts):
            words = cut(texts.slice(begin, end - begin), GAPS, STOPS)
            m = len(words.ids) - n + 1
            if m <= 0:
                continue
            lang = code[begin:end][words.text]
            keep = (words.text[:m] == words.text[n - 1 :]) & (words.piece[:m] == words.piece[n - 1 :])
            if n > 1:
                bucket = gram_hashes(words.hashes()[words.ids], n - 1, seeds[lang]) % np.uint64(8 * len(frequent.value))
                known = (frequent.value[bucket >> np.uint64(3)] >> (bucket & np.uint64(7)).astype(np.uint8)) & 1
                keep &= (known[:m] & known[1 : m + 1]).astype(bool)
            at = np.flatnonzero(keep)
            if not len(at):
                continue
            parts = [words.ids[at + i] for i in range(n)]
            one, times = _counted(lang[at], parts, len(words.vocabulary))
            spoken = [words.vocabulary.take(pa.array(p[one])) for p in parts]
            phrase = pc.binary_join_element_wise(*spoken, pa.scalar(b" ", pa.large_binary())) if n > 1 else spoken[0]
            said = pa.array(names, pa.string()).take(pa.array(lang[at][one]))
            yield pa.RecordBatch.from_arrays([said, phrase.cast(pa.large_string()).cast(pa.string()), pa.array(times.astype(np.int64))], ["lang", "phrase", "n"])
            if n == 1:
                total = np.bincount(lang, minlength=len(names))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.nulls(len(names), pa.string()), pa.array(total.astype(np.int64))], ["lang", "phrase", "n"])


def _bit_map(frequent: DataFrame, n: int) -> np.ndarray:
    """The packed bits of n-grams (lang, phrase), built in parts by tasks; at most MAP_BITS bits come to the driver."""
    size, part = MAP_BITS, min(MAP_BITS, PART_BITS)

    def buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            words = np.array([xxhash.xxh3_64_intdigest(w.encode()) for p in pdf["phrase"] for w in p.split(" ")], np.uint64)
            b = gram_hashes(words, n, np.repeat(_seeds(pdf["lang"].to_list()), n))[::n] % np.uint64(size)
            yield pd.DataFrame({"part": (b // np.uint64(part)).astype(np.int32), "bit": (b % np.uint64(part)).astype(np.int32)})

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(part, np.uint8)
        bits[pdf["bit"].to_numpy()] = 1
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    at = frequent.select("lang", "phrase").mapInPandas(buckets, "part int, bit int").distinct()
    out = np.zeros(size // 8, np.uint8)
    for r in at.groupBy("part").applyInPandas(packed, "part int, bits binary").toLocalIterator():
        begin = r["part"] * part // 8
        out[begin : begin + part // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def frequent_phrases(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, lang: str = "lang", text: str = "text", scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, n) of all phrases of up to max_words words that occur `least` times, (lang, n) of all words)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "phrases")
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text"))
    found, total, bits = None, None, None
    for n in range(1, max_words + 1):

        def explode(batches, n=n, bits=bits):
            return _grams(batches, n, bits)

        each = rows.mapInArrow(explode, "lang string, phrase string, n long")
        summed = each.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("phrase").isNull() | (F.col("n") >= least))
        level = scratch.keep(summed.select("lang", "phrase", F.lit(n).alias("words"), "n"), f"of-{n}")
        if n == 1:
            total = level.where("phrase is null").select("lang", "n")
            level = level.where("phrase is not null")
        found = level if found is None else found.unionByName(level)
        if n < max_words:
            bits = spark.sparkContext.broadcast(_bit_map(level, n))
    return found, total


def collocations(
    docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, share: int = SHARE, most: int = MOST, lang: str = "lang",
    text: str = "text", scratch: Scratch | None = None,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `most` best phrases of 2 to max_words words.

    a counts the phrase, l and r the two parts of its lowest-scoring cut, n all words of the language; score is
    floor(1000000 a a / (l r)), in decimals. Phrases inside a longer one that is at least `share` percent as frequent are
    left out: it is enough to look at extensions by one word, as one by more contains one that is as frequent or more.
    Order: score, a (both descending), phrase by bytes.

    Null texts are empty; null languages count as `und`. Very long texts are read whole and cut alone. Rows that repeat
    count each time. Other columns are not looked at, whatever their names. An empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "collocations")
    found, total = frequent_phrases(docs, max_words, least, lang, text, scratch)
    split = F.split("phrase", " ")
    own = found.where("words > 1").withColumnRenamed("n", "a")
    cuts = own.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), split.alias("w"))
    cuts = cuts.withColumn("left", F.array_join(F.slice("w", 1, F.col("k")), " "))
    cuts = cuts.withColumn("right", F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ")).drop("w")
    shorter = found.where(F.col("words") < max_words)
    cuts = cuts.join(shorter.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(shorter.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    a, left, right = (F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r"))
    floor = F.expr("cast(aa as decimal(38,0)) div lr")
    scored = cuts.withColumn("aa", F.lit(1_000_000).cast("decimal(7,0)") * (a * a)).withColumn("lr", left * right).withColumn("score", floor)
    lowest = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    lowest = scratch.keep(lowest.select("lang", "phrase", "words", "a", "m.l", "m.r", "m.score"), "scored")
    inner = F.explode(F.array(F.array_join(F.slice(split, 1, F.col("words") - 1), " "), F.array_join(F.slice(split, 2, F.col("words") - 1), " ")))
    longer = own.where("words > 2").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    same = (lowest["lang"] == longer["lang"]) & (lowest["phrase"] == longer["phrase"]) & (100 * longer["longer"] >= share * lowest["a"])
    kept = lowest.join(longer, same, "left_anti").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    best = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    # a row per language
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
