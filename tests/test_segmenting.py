"""Cheapest paths against all paths, and words of mixed scripts in an index."""

import random
import time

from pyspark.sql import functions as F

from strataloom.functions import segmenting
from strataloom.functions.text import words
from strataloom.operators.kept_index import KeptIndex


def _all_paths(run, costs):
    if not run:
        return [(0, 0, (), ())]
    out = []
    for k in range(1, len(run) + 1):
        own = costs.known.get(run[-k:], costs.other if k == 1 else None)
        if own is not None:
            out += [(c + own, n + 1, (-k, *back), (*parts, run[-k:])) for c, n, back, parts in _all_paths(run[:-k], costs)]
    return out


def test_against_all_paths():
    r = random.Random(3)
    for _ in range(60):
        known = {"".join(r.choices("abc", k=r.randint(1, 4))): r.choice([5, 5, 10, 20]) for _ in range(12)}
        costs = segmenting.Costs(known, 30)
        run = "".join(r.choices("abcx", k=r.randint(0, 11)))
        assert segmenting.cheapest(run, costs) == list(min(_all_paths(run, costs))[3])


def test_a_lattice_of_many_runs_cuts_like_the_path_of_each(monkeypatch):
    r = random.Random(5)
    for n in range(60):
        known = {"".join(r.choices("ab\nc東", k=r.randint(1, 5))): r.choice([0, 5, 5, 10, 20]) for _ in range(n % 14)}
        costs = segmenting.Costs(known, 30)
        runs = ["".join(r.choices("ab\ncx東😀", k=r.randint(0, 40))) for _ in range(30)]
        monkeypatch.setattr(segmenting, "LONG", r.choice([3, 4096]))  # longer pieces are cut by themselves
        monkeypatch.setattr(segmenting, "CHUNK_CHARS", r.choice([50, 1 << 19]))
        assert segmenting.Lattice(costs).cut(runs) == [segmenting.cheapest(x, costs) for x in runs]


def test_long_texts_take_time_in_proportion(spark):
    """A million characters of 24-letter reach, and 200,000 words in a row: each took minutes."""
    r = random.Random(7)
    known = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 12))) for _ in range(3000)] + ["q" * 24]
    costs = segmenting.Costs({w: r.randint(3000, 12000) for w in known}, 15000)
    told = r.choices(known[:-1], k=130_000)
    began = time.process_time()
    assert "".join(segmenting.Lattice(costs).cut(["".join(told)])[0]) == "".join(told)
    assert time.process_time() - began < 15
    rows = spark.createDataFrame([(["ab"] * 200_000, ["ab", "ab", "abab"] * 50_000)], "told array<string>, found array<string>")
    began = time.monotonic()
    got = segmenting.agreement(rows, F.col("told"), F.col("found")).select("ends", "found_ends", "hits").first()
    assert tuple(got) == (200_000, 150_000, 150_000) and time.monotonic() - began < 30


def test_learned_costs_and_odd_texts(spark):
    rows = spark.createDataFrame([("the cat the dog",), ("the",), (None,), ("",), ("x" * 30,)], "t string")
    costs = segmenting.learned(rows, "t")
    assert set(costs.known) == {"the", "cat", "dog"} and costs.known["the"] == segmenting.cost(3, 6) < costs.known["cat"] < costs.other
    assert set(segmenting.learned(rows, "t", most=2).known) == {"the", "cat"}
    cut = segmenting.cutter(spark, costs)
    got = spark.createDataFrame([("thedogthecat",), ("dogz",), ("",), (None,), ("thethe" * 5000,)], "t string").select(cut(F.col("t")).alias("w")).collect()
    assert [r["w"] for r in got[:4]] == [["the", "dog", "the", "cat"], ["dog", "z"], [], []] and len(got[4]["w"]) == 10_000
    nothing = segmenting.learned(rows.where("false"), "t")
    assert segmenting.cheapest("ab", nothing) == ["a", "b"]


def test_ends_of_words(spark):
    rows = spark.createDataFrame([(["ab", "c", "d"], ["ab", "cd"]), ([], [])], "told array<string>, found array<string>")
    got = segmenting.agreement(rows, F.col("told"), F.col("found")).select("ends", "found_ends", "hits").collect()
    assert [tuple(r) for r in got] == [(3, 2, 2), (0, 0, 0)]


def test_an_index_of_words_without_blanks(spark, tmp_path):
    """Pairs of characters find 京都 inside 東京都; words don't."""
    spaced = spark.createDataFrame([("東京 都 に 住む",), ("京都 に 住む",), ("東京 都 の 東京",)], "t string")
    costs = segmenting.learned(spaced, "t", lambda c: F.split(c, " "))
    analyse = segmenting.analyser(spark, costs)
    docs = spark.createDataFrame([(1, "東京都に住む API v2"), (2, "京都に住む"), (3, "Plain words only")], "id long, text string")
    asked = spark.createDataFrame([(1, "京都"), (2, "API"), (3, "東京")], "query_id long, question string")
    hits = {}
    for name, how in (("pairs", words), ("words", analyse)):
        index = KeptIndex(spark, str(tmp_path / name), analyse=how)
        index.upsert(docs, "id", "text")
        hits[name] = {(r["query_id"], r["id"]) for r in index.search(asked).collect()}
    assert hits["words"] == {(1, 2), (2, 1), (3, 1)} and (1, 1) in hits["pairs"]


def test_ends_are_compared_without_words(spark, monkeypatch):
    """recut() gives what agreement() of cutter()'s words gives, and makes no word; cutter() makes those of some texts at a time."""
    r = random.Random(11)
    known = ["ab", "abc", "c", "東京", "京都", "x😀", "q" * 24]
    costs = segmenting.Costs({w: r.randint(1, 9) for w in known}, 12)
    rows = [(i, r.choices([*known, "z", ""], k=r.randint(0, 30))) for i in range(40)] + [(40, []), (41, None)]
    told = spark.createDataFrame(rows, "n int, told array<string>")
    columns = ["n", "ends", "found_ends", "hits"]
    cut = told.where("told is not null").withColumn("found", segmenting.cutter(spark, costs)(F.array_join("told", "")))
    want = sorted(map(tuple, segmenting.agreement(cut, F.col("told"), F.col("found")).select(*columns).collect()))
    got = segmenting.recut(told, F.col("told"), costs).select(*columns).collect()
    assert sorted(map(tuple, got)) == [*want, (41, None, None, None)]
    lattice = segmenting.Lattice(costs)
    texts, sizes = ["".join(t) for _, t in rows[:41]], [[len(w) for w in t] for _, t in rows[:41]]
    whole = lattice.agreed(texts, sizes).tolist()
    assert [tuple(x) for x in whole] == [x[1:] for x in want]
    monkeypatch.setattr(segmenting, "CHUNK_CHARS", 50)
    assert lattice.agreed(texts, sizes).tolist() == whole and max(map(len, lattice.parts(texts))) < 41
    monkeypatch.setattr(segmenting.Lattice, "parts", None)
    assert lattice.agreed(texts, sizes).tolist() == whole
