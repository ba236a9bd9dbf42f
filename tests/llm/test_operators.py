import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import ann, common, language, mixing, near_vectors, ngram_join, packing, quality, queries, token_counts, token_files, tokens, url_filter
from strataloom.llm.common import Scratch, connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, size long"
LONG = "wordy " * 60_000
ODD = [
    (1, "the same words stand here twice over", "en", "a", 1, 0.0, 0, 0), (1, "the same words stand here twice over", "en", "a", 1, 0.0, 0, 0),
    (2, "The same words, stand here twice OVER!", "en", None, 1, 0.0, 0, 0), (None, "nobody knows this one", None, None, None, None, None, None),
    (4, None, "en", "b", 1, 0.0, 0, 0), (5, "", None, "b", 1, 0.0, 0, 0), (6, " \n\t ", "fr", "b", 1, 0.0, 0, 0), (7, LONG, "en", "a", 1, 0.0, 0, 0),
    (8, "12 34 !!", "en", "c", 1, 0.0, 0, 0), (9, "x", "fr", "", 1, 0.0, 0, 0), (10, "<|endoftext|> 😀 naïve\x00\u3000é", "fr", "c", 1, 0.0, 0, 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (8, 7), (7, 9), (5, 5), (20, 10), (20, 30), (30, 40)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges, Scratch(spark)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 10: 10, 20: 10, 30: 10, 40: 10}


def test_one_operator_holds_caches(monkeypatch):
    monkeypatch.setattr(common, "_HOLDER", [])
    dropped = []
    for owner in ("a", "a", "b", "a"):
        common.hold(owner, lambda owner=owner: dropped.append(owner))
    assert dropped == ["a", "b"]
    mine = tokens.encoder(tokens.vocabulary(tokens.WORD_FILE), True)
    assert tokens._ENCODERS and mine is tokens.encoder(tokens.vocabulary(tokens.WORD_FILE), True)
    list(ngram_join._signatures(iter([]), 5))
    assert not tokens._ENCODERS and len(next(mine.encode(["still works"]))[1])


# 1


def test_mix(spark, odd, empty):
    rows = [(i, "w " * (1 + i % 37), "abc"[i % 3] if i % 10 else None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).toPandas()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(t.split())
    names = sorted(s for s in size if s is not None) + [None]
    weight = dict(zip(names, [5, 2, 1] * 9))
    target, free, goal = {}, set(names), 1.5 * sum(size.values())
    while free:
        left = goal - sum(target.values())
        full = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s] + 1e-9}
        if not full:
            target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        target |= {s: 2.0 * size[s] for s in full}
        free -= full
    by = got.merge(docs.toPandas()[["doc_id", "source"]], on="doc_id")
    for s in names:
        own = by[by["source"].isna() if s is None else by["source"] == s]
        assert own["target"].iloc[0] == pytest.approx(target[s]) and own["source_size"].iloc[0] == size[s]
        assert own["taken"].sum() == pytest.approx(target[s], rel=0.01)
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] % got["size"] == 0).all()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert got.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(empty).count() == 0
    assert mixing.mixture(odd).columns == odd.columns and mixing.mixture(empty).count() == 0
    total = mixing.mix(odd).agg(F.sum("copies")).first()[0]
    assert mixing.mixture(odd).count() == total


def test_equal_rows_use_all_chunks(spark):
    docs = spark.createDataFrame([(1, "same words here", "a")], "doc_id long, text string, source string")
    docs = docs.withColumn("doc_id", F.lit(None).cast("long")).crossJoin(spark.range(20_000)).drop("id")
    rows = docs.select(F.lit(False).alias("sn"), "source", "doc_id", F.lit(0).alias("carried"), F.lit(3).alias("size"), F.lit(20_000).alias("docs"))
    per = mixing._dealt(rows).groupBy("chunk").count().toPandas()["count"]
    assert len(per) == 20 and per.max() < 1300 and per.sum() == 20_000
    got = mixing.mix(docs).agg(F.count("*"), F.sum("taken"), F.max("target"), F.max("copies")).first()
    assert got[0] == 20_000 and got[1] == pytest.approx(got[2], rel=1e-3) and got[3] == 2
    assert mixing.mixture(docs).count() == pytest.approx(got[1] / 3, rel=1e-3)


def test_rates_are_the_entropy_optimum(spark):
    """Against a plain solver: per source the tilt that meets the target, found by bisection."""
    sizes = {"a": [3, 50, 7, 7, 120, 30, 1, 2], "b": [10, 20, 400, 5], "c": [6] * 9}
    docs = spark.createDataFrame([(i, "w " * n, s) for s, own in sizes.items() for i, n in enumerate(own)], "doc_id long, text string, source string")
    for r in mixing.mix(docs).groupBy("target", "source_size").agg(F.collect_list(F.struct("size", "rate")).alias("x")).collect():
        n = np.array([x["size"] for x in r["x"]], float)
        low, high = -1e5, 1e5  # a source that is taken whole has its tilt at infinity
        for _ in range(200):
            tilt = (low + high) / 2
            rates = 2 / (1 + np.exp(-np.clip(tilt * n / n.mean(), -700, 700)))
            low, high = (tilt, high) if (rates * n).sum() < r["target"] else (low, tilt)
        assert np.allclose([x["rate"] for x in r["x"]], rates, atol=1e-4)


def test_an_unmet_target_is_an_error(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i), "ab"[i % 2]) for i in range(30)], "doc_id long, text string, source string")
    scratch = Scratch(spark)
    rows = docs.select(F.lit(False).alias("sn"), F.col("source").alias("sk"), mixing.word_count(F.col("text")).alias("size"))
    hist = rows.groupBy("sn", "sk", "size").agg(F.count("*").alias("n"))
    targets = mixing.source_targets(rows, scratch, (5, 2, 1), 1.5, 2)
    with pytest.raises(RuntimeError):
        mixing.solve_tilts(hist, targets, scratch, 2, steps=1)


# 2 and 7


def _vectors(spark, n=400, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[50:90] = x[50] + 0.05 * rng.standard_normal((40, dim))
    x[90:95] = x[90]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * dim), (1002, [float("nan")] * dim), (1003, [None] * dim), (1004, [1.0, 2.0]), (0, x[0].tolist()), (None, x[3].tolist()), (1005, [])]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_near_vectors(spark):
    x, vectors = _vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(1) - 1
    got = near_vectors.near_vectors(vectors).toPandas()
    per = got[got["vec_id"].notna() & (got["vec_id"] < 400)].groupby("vec_id").first()
    want = links.copy()
    want[0] += 1
    want[3] += 1
    assert per["n_links"].tolist() == want.tolist()
    assert set(per["component_id"].iloc[50:90]) == {50} and set(per["component_id"].iloc[90:95]) == {90}
    assert got[got["vec_id"] >= 1000]["n_links"].sum() == 0 and len(got) == vectors.count()
    assert near_vectors.near_vectors(vectors.limit(0)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, order = near_vectors.Graph.build(x, 1)
    q = x[::30]
    ids, _ = graph.search(q, 128)
    best = np.argsort(-(q @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(order[a[:5]]) & set(b)) / 5 for a, b in zip(ids, best)]) >= 0.9


def test_planted_clusters_in_large_shards(spark, monkeypatch):
    """Graphs of about 3000 nodes, groups of 2, 30 and 500 among them: every link is found, by beams and not by scans."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((9000, 24))
    at = 0
    for size, times in ((2, 200), (30, 10), (500, 1)):
        for _ in range(times):
            x[at : at + size] = x[at] + 0.12 * rng.standard_normal((size, 24))
            at += size
    rows = [(i, v.tolist(), 1, 1, 1) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key int, shard int, block int")
    scratch = Scratch(spark)
    kept = {}
    keep = scratch.keep
    monkeypatch.setattr(scratch, "keep", lambda df, name: kept.setdefault(name, keep(df, name)) if name == "graphs" else keep(df, name))
    monkeypatch.setattr(scratch, "drop", lambda *tables: None)
    got = near_vectors.near_vectors(vectors, scratch=scratch).toPandas().sort_values("vec_id")
    graphs = kept["graphs"].select("beam", "recall").toPandas()
    assert len(graphs) == 3 and (graphs["beam"] > 0).all() and graphs["recall"].min() >= 0.99
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    assert near.sum(1).max() > 100
    assert got["n_links"].tolist() == (near.sum(1) - 1).tolist()
    root = near_vectors.local_roots(*np.nonzero(near), len(x))
    assert got["component_id"].tolist() == root.tolist() and got["kept"].tolist() == (root == np.arange(len(x))).tolist()


def test_audit_widens_at_last_to_a_scan():
    rng = np.random.default_rng(6)
    x, q = rng.standard_normal((1200, 16)), rng.standard_normal((2000, 16))
    graph, order = near_vectors.Graph.build(near_vectors.unit(x), 1)
    graph.adjacent = [np.where(a % 2 == 1, -1, a) for a in graph.adjacent]  # no edge leads to every other node
    beam, recall = graph.audit(graph.probes(1, 0.95), 0.9499, near_vectors.BEAM)
    assert beam == 0 and recall == 1
    rare = np.random.default_rng(len(q)).permutation(len(q))[-5:]  # an audit's own queries are the first of these
    q[rare] = x[order][1:11:2] + 0.001
    raw, keys = x[order], np.arange(len(x))
    got = near_vectors._ask(graph, keys, np.ones(len(x), int), raw, 10_000 + np.arange(len(q)), q, 0.95, beam)
    u, v = near_vectors.unit(q), near_vectors.unit(raw)
    want = (u @ v.T >= 0.95).sum(1)
    assert want[rare].min() >= 1
    linked = got.set_index("key")["linked"].reindex(10_000 + np.arange(len(q)), fill_value=0)
    assert linked.tolist() == want.tolist()


EXTREME = [(1, [1e200, 1e200, 0.0]), (2, [2e200, 2e200, 0.0]), (3, [1e-200, 1e-200, 0.0]), (4, [1.0, 1.0, 0.0]), (5, [0.0, 0.0, 1.0]), (6, [1e-310, 1e-310, 0.0])]


def test_huge_and_tiny_components(spark):
    clashing = "vec_id long, embedding array<double>, query_id int, score string, rank int, dim int, code int, key int, n int, copies int, least int"
    vectors = spark.createDataFrame([(*r, *[7] * 1, "x", *[7] * 7) for r in EXTREME], clashing)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near_vectors(vectors).collect()}
    assert got == {i: (4, 1) for i in (1, 2, 3, 4, 6)} | {5: (0, 5)}
    for r in ann.search(ann.build_index(vectors), vectors, k=5).collect():
        assert r["score"] == pytest.approx(0.0 if 5 in (r["query_id"], r["vec_id"]) else 1.0)
    con = duckdb.connect()
    con.sql("CREATE TABLE embeddings AS SELECT * FROM (VALUES " + ", ".join(f"({i}, {v}::DOUBLE[])" for i, v in EXTREME) + ") t(vec_id, embedding)")
    assert {r[0]: r[1] for r in con.sql(queries.oracle_sql()["op2_near_vectors"]).fetchall()} == {i: n for i, (n, _) in got.items()}


def test_nearest(spark):
    x, vectors = _vectors(spark)
    got = ann.search(ann.build_index(vectors), vectors.where("vec_id % 50 = 0"), k=5).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 400, 50):
        cos = u @ u[q]
        cos[q] = -2
        own = got[got["query_id"] == q].sort_values("rank")
        assert len(own) == 5 and own["score"].is_monotonic_decreasing
        hits += len(set(own["vec_id"]) & set(np.argsort(-cos, kind="stable")[:5]))
        total += 5
    assert hits / total >= 0.9
    assert ann.search(ann.build_index(vectors), vectors.limit(0)).count() == 0
    assert ann.search(ann.build_index(vectors.limit(0)), vectors).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(9)
    x, q = rng.standard_normal((3000, 64)), rng.standard_normal((200, 64))
    packed, scale = ann.encode(x)
    codes = ann.Codes(packed, scale, 64)
    cos = near_vectors.unit(q) @ near_vectors.unit(x).T
    off = np.abs(codes.estimate(q) - cos)
    assert (off > codes.bound).mean() < 1e-4 and codes.bound.mean() < 0.2


def test_nearest_of_many_copies(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 16))
    x[1000:2000] = x[1000]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(ann.build_index(vectors), vectors.where("vec_id in (1000, 1500, 7)"), k=5).toPandas()
    own = {q: g.sort_values("rank")["vec_id"].tolist() for q, g in got.groupby("query_id")}
    assert own[1000] == [1001, 1002, 1003, 1004, 1005] and own[1500] == [1000, 1001, 1002, 1003, 1004] and len(own[7]) == 5


def test_nearest_of_repeated_ids(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x) for _ in range(2)]
    for i in range(0, 300, 50):  # one near id stands in many rows, as copies and as vectors of its own
        rows += [(1000 + i, (x[i] + 0.01 * rng.standard_normal(16)).tolist()) for _ in range(40)]
        rows += [(1001 + i, (2 * x[i]).tolist())] * 8
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries_ = vectors.where("vec_id < 300 and vec_id % 50 = 0")
    got = ann.search(ann.build_index(vectors), queries_, k=5).toPandas()
    ids, y = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    u = y / np.linalg.norm(y, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        best = {}
        for i, c in zip(ids.tolist(), (u @ (x[q] / np.linalg.norm(x[q]))).tolist()):
            if i != q:
                best[i] = max(c, best.get(i, -2))
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["vec_id"].tolist() == sorted(best, key=lambda i: (-round(best[i], 12), i))[:5]
        assert np.allclose(own["score"], sorted(best.values(), reverse=True)[:5])


# 3


def _counts(texts, order):
    keys = [np.unique(language._grams([t.encode() for t in own], order), return_counts=True) for own in texts.values()]
    return language.Counts(order, list(texts), [k for k, _ in keys], [c for _, c in keys])


def _ppm_bits(learned, text, order):
    """Plain prediction by partial matching: dictionaries of contexts, escape method C with exclusion, byte after byte."""
    seen = defaultdict(Counter)
    for t in learned:
        data = b" " * order + t.encode()
        for i in range(order, len(data)):
            for o in range(order + 1):
                seen[data[i - o : i]][data[i]] += 1

    def share(context, byte, depth=0):
        if depth > len(context):
            return 1 / 256
        own = seen.get(context[depth:])
        if not own:
            return share(context, byte, depth + 1)
        total, kinds = sum(own.values()), len(own)
        if kinds == 256:
            return own[byte] / total
        if byte in own:
            return own[byte] / (total + kinds)
        room = 1 - sum(share(context, other, depth + 1) for other in own)
        return kinds / (total + kinds) * share(context, byte, depth + 1) / room

    data = b" " * order + text.encode()
    return -sum(np.log2(share(data[i - order : i], data[i])) for i in range(order, len(data)))


@pytest.mark.parametrize("order", [1, 2, 4])
def test_code_lengths_against_plain_matching(order):
    texts = {"el": ["η γάτα κάθεται στο χαλί", "το σπίτι"], "en": ["the cat sat on the mat and the rat", "a hat"], "ja": ["猫が座った。", "家と犬と猫"], "ru": ["кошка сидит на ковре"]}
    model = language.Model(_counts(texts, order))
    asked = ["the mat", "猫と家", "коврик", "γάτα?", "x", "", "\x00\u07ff"]
    bits = model.code_lengths([t.encode() for t in asked])
    want = [[_ppm_bits(own, t, order) for own in texts.values()] for t in asked]
    assert np.allclose(bits, want, atol=1e-6)
    for tree in model.trees:  # the shares of every byte after a context sum to one
        contexts = np.unique(np.concatenate([tree.levels[-1][2], [np.uint64(7)]]))[:50]
        keys = (contexts[:, None] << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert np.allclose(np.exp2(-tree.cost(keys.ravel())).reshape(-1, 256).sum(1), 1)


def test_no_context_is_left_out_of_many_languages():
    rng = np.random.default_rng(5)
    texts = {f"l{k:02d}": [" ".join("".join(chr(0x100 + 40 * k + c) for c in rng.integers(0, 40, 6)) for _ in range(300))] for k in range(48)}
    model = language.Model(_counts(texts, 4))
    asked = [t[0][100:400] for t in texts.values()]
    bits = model.code_lengths([t.encode() for t in asked])
    assert bits.argmin(1).tolist() == list(range(48))
    for tree, (own,) in zip(model.trees, texts.values()):
        assert len(tree.levels[3][0]) == len(np.unique(language._grams([own.encode()], 4)))
    for k in (0, 20, 47):
        assert bits[k, k] == pytest.approx(_ppm_bits(texts[f"l{k:02d}"], asked[k], 4))


def test_long_texts_are_scored_whole(monkeypatch):
    model = language.Model(_counts({"en": ["the cat sat on the mat"], "fr": ["le chat et le rat"]}, 4))
    text = "the cat sat et le rat " * 40
    whole = model.code_lengths([text.encode(), b"a rat"])
    monkeypatch.setattr(language, "SLICE_BYTES", 7)
    assert np.allclose(model.code_lengths([text.encode(), b"a rat"]), whole)


def test_learning_is_bounded_and_misses_no_language(spark):
    rows = [(i, "wort " * 400, "de") for i in range(300)] + [(None, "mot " * 900_000, "fr"), (7, "λέξη", "el"), (8, None, "es"), (9, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.learn(docs, docs_per_lang=50, bytes_per_lang=100_000)
    assert got.langs == ["de", "el", "fr"]
    assert 20 * 2000 <= got.counts[0].sum() <= 90 * 2000 and got.counts[2].sum() == 4 * 900_000


def test_language(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op3_language_id(spark, SF).join(docs, "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() >= 0.95 and got["score"].between(0, 1).all()
    told = {(r["doc_id"], r["text"]): r for r in language.identify(odd, docs).collect()}
    assert len(told) == len(ODD) - 1
    for k in ((4, None), (5, ""), (6, " \n\t "), (8, "12 34 !!")):
        assert told[k]["lang_pred"] == "und" and told[k]["lang_score"] == 0
    assert told[(7, LONG)]["lang_pred"] == "en" and language.identify(empty, docs).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, empty).collect()} == {"und"}


# 4, 5, 6


def _library(vocab, texts, end=None):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary(vocab))
    return t.encode_batch([x or "" for x in texts], add_special_tokens=False)


@pytest.mark.parametrize("vocab, words", [(tokens.WORD_FILE, True), (tokens.BYTE_FILE, False)])
def test_encoder(spark, vocab, words):
    texts = [t or "" for _, t, *_ in ODD] + ["a  b\r\n\r\n c", "It's 'tis don’t e.g., (x) A.B c!!", "\ue000 x \ue000", "İ ΣΑΣ ½² ﬁ", "x\x1cy\x1c z", "Ø" * 70]
    texts += ["abc <|endoftext|> def", "abc<|endoftext|>def", "<|startoftext|><|endoftext|> ", " <|ENDOFTEXT|> <|endoftext", "a  <|endoftext|>\n b <| c |>"]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    own = tokens.Encoder(tokens.vocabulary(vocab), words, not words)
    for first, ids, bounds, spans in own.encode(texts):
        for i, want in enumerate(_library(vocab, texts[first : first + len(bounds) - 1])):
            part = slice(bounds[i], bounds[i + 1])
            assert ids[part].tolist() == want.ids
            if spans is not None:
                assert [tuple(x) for x in spans[part].tolist()] == want.offsets


def test_token_counts(odd, empty):
    for rule in token_counts.RULES:
        got = token_counts.token_counts(odd, rule=rule).toPandas()
        sums = got.groupby(["doc_id", "doc_tokens"], dropna=False)["n_tokens"].sum()
        want = Counter()
        for (k, t, *_), e in zip(ODD, _library(tokens.BYTE_FILE, [t for _, t, *_ in ODD])):
            want[(k, len(e.ids))] += len(e.ids)
        assert sorted(sums.round(6)) == sorted(want.values())
    assert token_counts.token_counts(empty).count() == 0


def test_crossing_tokens():
    spans, starts = np.array([[0, 2], [2, 7], [7, 8], [8, 8]]), np.array([0, 3, 5])
    assert token_counts.attribute(spans, starts, 8, "overlap")[0].tolist() == [1, 1, 2]
    assert token_counts.attribute(spans, starts, 8, "first")[0].tolist() == [2, 0, 2]
    counts, crossing = token_counts.attribute(spans, starts, 8, "share")
    assert counts.tolist() == [1.2, 0.4, 2.4] and crossing.tolist() == [1, 1, 1]


def test_packing(spark, odd, empty):
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        got = packing.pack(docs).toPandas()
        want = Counter()
        rows = docs.collect()
        for r, e in zip(rows, _library(tokens.WORD_FILE, [r["text"] for r in rows])):
            ids = np.array([*e.ids, 0], "<u4")
            for k, s in enumerate(range(0, len(ids), 2048)):
                want[(r["doc_id"], k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()))] += 1
        cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
        assert Counter((None if r[0] != r[0] else int(r[0]), *map(int, r[1:])) for r in got[cols].itertuples(index=False)) == want
        s = got.sort_values(["sequence_id", "offset"])
        assert (s["offset"] == s.groupby("sequence_id")["length"].cumsum() - s["length"]).all()
        per = s.groupby("sequence_id")["length"].sum()
        assert per.max() <= 2048 and len(per) <= 1.02 * per.sum() / 2048 + 1
    assert packing.pack(empty).count() == 0


def test_bounded_bins():
    bins = packing.Bins(10, 2)
    assert [bins.add(s) for s in (6, 7, 4, 8, 3)] == [(0, 0), (1, 0), (0, 6), (2, 0), (1, 7)]
    bins = packing.Bins(10, 2)
    assert [bins.add(s)[0] for s in (6, 7, 8, 3)] == [0, 1, 2, 0]  # the fullest, of 7, has closed


def test_token_files(spark, odd, empty, tmp_path):
    got = token_files.round_trip(odd).toPandas().sort_values("start")
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    whole = [np.array([*e.ids, 1], "<u4") for e in _library(tokens.WORD_FILE, [r[1] for r in rows])]
    lens = [len(x) for x in whole]
    assert sorted(got["ids_crc32"]) == sorted(zlib.crc32(x.tobytes()) for x in whole)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    told = {r["doc_id"]: r["ids_crc32"] for r in token_files.round_trip(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for r, e in zip(docs, _library(tokens.WORD_FILE, [r["text"] for r in docs])):
        assert told[r["doc_id"]] == zlib.crc32(np.array([*e.ids, 1], "<u4").tobytes())
    assert got["n_tokens"].tolist() == lens and got["start"].tolist() == np.cumsum([0, *lens[:-1]]).tolist()
    assert token_files.round_trip(empty).count() == 0
    path = str(tmp_path / "x.zst")
    w = token_files.Writer(path, False)
    data = {i: np.arange(i * 1000, dtype=np.uint32) % 40_000 for i in (1, 300, 5, 900)}
    for k, ids in data.items():
        w.add(k, ids)
    w.close()
    r = token_files.Reader(path)
    assert [(k, ids.tolist()) for k, ids in r.documents()] == [(k, v.tolist()) for k, v in data.items()]
    assert [k for k, _ in r.documents([300, 77])] == [300]
    raw = bytearray(open(path, "rb").read())
    raw[int(r.starts[0]) + 40] ^= 255
    open(path, "wb").write(raw)
    with pytest.raises(Exception):
        list(token_files.Reader(path).documents([1]))


def test_rows_of_one_id_fill_several_files(spark):
    rows = [(None, f"text number {i}") for i in range(600)] + [(3, f"other {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scratch = Scratch(spark)
    manifest = scratch.keep(token_files.write_token_files(docs, scratch.path("files"), file_docs=100), "manifest")
    assert manifest.count() >= 8 and manifest.agg(F.max("docs")).first()[0] <= 400
    got = token_files.read_token_files(manifest, 4).toPandas().sort_values("start")
    assert len(got) == 1200 and got["doc_id"].isna().tolist() == [True] * 600 + [False] * 600


# 8


def test_quality(spark, odd, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rated = quality.rate_quality(odd, docs, labels)
    assert rated.columns == [*odd.columns, "quality_score"] and all(0 <= r["quality_score"] <= 1 for r in rated.collect())
    assert rated.where("quality_score is null").count() == 0 and quality.rate_quality(empty, docs, labels).count() == 0
    assert quality.rate_quality(odd, empty, labels).select("quality_score").distinct().count() == 1


def _auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1
    good = label == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_quality_of_held_out_documents(spark):
    """Labels of the held-out fold, which nothing is learned from, are told apart."""
    for sf in (SF, "/root/testdata/sf0.01"):
        got = queries.op8_quality_classifier(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
        assert len(got) > 10 and _auc(got["score"].to_numpy(), got["quality"].to_numpy()) >= 0.95
        assert (got["predicted"] == got["quality"]).mean() >= 0.9 and (got["predicted"] == (got["score"] >= 0.3)).all()


def test_trees():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 6))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.4)).astype(float)
    forest = quality.fit(x[:3000], y[:3000], rounds=60)
    score = forest.score(x[3000:])
    assert ((score > 0.5) == y[3000:]).mean() > 0.97
    for row, s in zip(x[3000:3020], score):  # one row at a time, node after node
        total = forest.base
        for root in forest.roots:
            at = root
            while forest.left[at] != at:
                at = forest.left[at] + (row[forest.feature[at]] > forest.cut[at])
            total += forest.value[at]
        assert s == pytest.approx(1 / (1 + np.exp(-total)))


# 9


def _brute(rows, words=5, least=0.8):
    sets = [set(ngram_join.shingles(t or "", words).tolist()) for _, t in rows]
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and b and len(a & b) / len(a | b) >= least:
                links[i].add(j)
    return links


def test_ngram_join(spark, odd, empty, monkeypatch):
    rng = np.random.default_rng(4)
    base = [f"w{rng.integers(400)}" for _ in range(200)]
    rows = [(1, " ".join(base))]
    for k in range(2, 60):
        own = list(base)
        for at in rng.integers(0, 200, int(rng.integers(0, 5))):
            own[at] = f"z{k}"
        rows.append((k, " ".join(own)))
    rows += [(k, " ".join(f"w{rng.integers(400)}" for _ in range(150))) for k in range(60, 90)] + [(90, "a b"), (91, "A, b!"), (92, None), (93, ""), (94, None)]
    links = _brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block, root in ((ngram_join.BLOCK_DOCS, ngram_join.BLOCK_ROOT), (16, 1)):  # the second deals the group as pairs of blocks
        monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
        monkeypatch.setattr(ngram_join, "BLOCK_ROOT", root)
        got = {r["doc_id"]: r for r in ngram_join.similar_documents(docs).collect()}
        assert {k: got[k]["n_links"] for k, _ in rows} == {k: len(links[i]) for i, (k, _) in enumerate(rows)}
        assert got[90]["class_id"] == got[91]["class_id"] == 90 and got[94]["class_id"] == 94
    told = {(r["doc_id"], r["text_hash"]): r for r in ngram_join.similar_documents(odd).collect()}
    assert len(told) == len(ODD) - 1 and sum(r["n_links"] for r in told.values()) == 2 + 2
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (1, 2)").count() == 1 and kept.count() == len(ODD) - 2
    assert ngram_join.similar_documents(empty).count() == 0 and ngram_join.one_of_each(empty).count() == 0


def test_long_documents_on_one_side_link_once(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 150)  # two documents of 150 words are dealt to two sides
    rows = []
    for k in range(8):
        base = [f"w{k}x{i}" for i in range(150)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:-1]))]
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == {i: (i // 2 * 2, 1) for i, _ in rows}


def test_planted_pairs_are_found(spark):
    """Pairs just above the threshold, where bands and pruning lose most."""
    rng = np.random.default_rng(7)
    rows = []
    for k in range(1500):
        n = int(rng.integers(60, 400))
        own = [f"p{k}w{i}" for i in range(n)]
        cut = int(0.1 * n)  # of n - 4 shingles, n - 4 - cut are shared: a similarity of 0.8 and a little more
        other = own[: n - cut] + [f"q{k}w{i}" for i in range(int((n - 4 - cut) / 0.8) - (n - 4))] if k % 2 else own[: n - int(0.19 * (n - 4))]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
    want = {2 * k for k in range(1500) if len(_brute(rows[2 * k : 2 * k + 2])) == 2}
    assert len(want) > 600
    got = {r["doc_id"] for r in ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("n_links > 0").collect()}
    assert {i for i in got if i % 2 == 0} == want


def test_pruning_keeps_what_reaches_the_threshold():
    for n, least in ngram_join.least_matches():
        assert least <= n * 0.8
    looks = dict(ngram_join.least_matches())
    assert looks[192] > 100 and looks[16] <= 5


# 10


def test_urls(spark):
    link = '<a href="//b.org/x">l</a><a class=x HREF=http://c.com/y>m</a><a href="mailto:x@y">n</a><a href="/own">o</a>'
    rows = [
        (1, "HTTP://A.Example.NET/en/x?q#f", link), (2, "https://example.net/de/", None), (3, "x://c.com", link), (4, None, link), (5, "no scheme", ""),
        (6, "http://b.org/fr/a", ""), (7, "http://b.org/en/a", link), (8, "http://myexample.com/de/", ""), (9, "http://www.example.com/de/a#b", link),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("example.net", "/de/", "net/", "block")
    assert got[3][:3] == ("c.com", "", None) and got[4] == got[5] == ("", "", None, "allow")
    assert got[6][2:] == ("org/fr/", "allow") and got[7][2:] == (None, "allow")
    assert got[8][2] is None and got[9][2:] == ("example.com/de/", "block")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_urls_of_odd_tables(spark):
    long = "<p>" * 200_000 + '<a href="http://spam.net/">x</a>'
    rows = [(1, "http://a.info/x", long, "v", "h", 5), (1, "http://a.info/x", long, "v", "h", 5), (None, None, None, None, None, None), (2, "http://a.info", "", "v", "p", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string, host string, rank int")
    got = sorted(map(tuple, url_filter.judge(pages).drop("trust").collect()), key=repr)
    assert got == sorted([(1, "a.info", "/x", None, "block"), (1, "a.info", "/x", None, "block"), (None, "", "", None, "allow"), (2, "a.info", "", None, "block")], key=repr)
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_linked_hosts_without_pages_seed(spark):
    rows = [
        (1, "http://p.info/a", '<a href="http://spam.net/x">l</a>'), (2, "http://q.info/a", '<a href="//p.info/a">l</a>'), (3, "http://r.info/a", '<a href="/a">l</a>'),
        (4, "http://s.info/a", '<a href="http://good.org/fr/a">l</a>'), (5, "http://good.org/en/a", '<a href="http://t.info/">l</a>'), (6, "http://t.info/", ""),
    ]
    got = {r["page_id"]: (r["verdict"], r["trust"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("block", 0.0), 2: ("block", 0.0), 3: ("allow", 0.5), 4: ("allow", 0.5), 5: ("allow", 1.0), 6: ("allow", 1.0)}


def test_distrust_reaches_far_hosts(spark):
    rows = [(0, "http://spam.net/", "")] + [(k, f"http://h{k}.info/", f'<a href="http://{f"h{k - 1}.info" if k > 1 else "spam.net"}/">l</a>') for k in range(1, 18)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {(r["verdict"], r["trust"]) for r in url_filter.judge(pages).collect()} == {("block", 0.0)}
    seeds = spark.createDataFrame([("spam.net", 1.0)], "host string, seed double")
    edges = spark.createDataFrame([(f"h{k - 1}.info" if k > 1 else "spam.net", f"h{k}.info", 1) for k in range(1, 18)], "src string, dst string, n long")
    with pytest.raises(RuntimeError):
        url_filter.propagate(edges, seeds, Scratch(spark), 0.85, rounds=8)


# pipeline


def test_pipeline(spark, odd, empty):
    """Each stage's rows on its own input against a plain version of it: the model applied text by text, links by all pairs."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    key = lambda rows: Counter((r["doc_id"], r["text"]) for r in rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = Scratch(spark).keep(stage(spark, docs, SF), "stage")
        assert out.schema == docs.schema
        rows = docs.collect()
        learned = docs.where(~common.held_out(F.col("doc_id")))
        if name == "quality":
            forest = quality.learn(learned, labels)
            want = [r for r in rows if forest.score(quality.features([r["text"] or ""]))[0] >= quality.THRESHOLD]
            bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
            assert len(bad & {r["doc_id"] for r in want}) <= 0.1 * len(bad)
        elif name == "language":
            model = language.Model(language.learn(learned))
            told = [language.predict([r["text"]], model).iloc[0] for r in rows]
            want = [r for r, t in zip(rows, told) if t["lang"] != "und" and t["score"] >= 0.5]
        elif name == "near_duplicates":
            links = _brute([(r["doc_id"], r["text"]) for r in rows])
            a, b = map(np.array, zip(*[(i, j) for i, js in links.items() for j in js]))
            order = np.argsort([r["doc_id"] for r in rows], kind="stable")
            place = np.argsort(order)
            root = near_vectors.local_roots(place[a], place[b], len(rows))
            want = [rows[order[i]] for i in range(len(rows)) if root[i] == i]
        else:
            taken = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, carry=F.xxhash64("doc_id", "text", "source")).collect()}
            want = [r for r in rows for _ in range(taken[r["doc_id"]])]
            by = {r["source"]: (r["size"], r["target"]) for r in mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("size"), F.max("target").alias("target")).collect()}
            assert all(abs(n - goal) <= max(0.2 * goal, 400) for n, goal in by.values()) and 0 < len(want)
        assert key(out.collect()) == key(want), name
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    rows = docs.collect()
    ids = {r["doc_id"]: len(e.ids) + 1 for r, e in zip(rows, _library(tokens.WORD_FILE, [r["text"] for r in rows]))}
    copies = Counter(r["doc_id"] for r in rows)
    assert packed.groupby("doc_id")["length"].sum().to_dict() == {k: n * copies[k] for k, n in ids.items()}
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048


def test_stages_take_odd_tables(spark, odd, empty):
    import corpus_pipeline

    kept = {name: Counter((r["doc_id"], r["text"]) for r in stage(spark, odd, SF).collect()) for name, stage in corpus_pipeline.STAGES[:-1]}
    whole = Counter((r[0], r[1]) for r in ODD)
    assert all(k in whole for rows in kept.values() for k in rows)
    assert not {None, "", " \n\t ", "12 34 !!"} & {t for _, t in kept["language"]}
    assert kept["near_duplicates"] == whole - Counter([ODD[0][:2], ODD[2][:2]])
    assert not any(not (t or "").split() for _, t in kept["mixing"])
    packed = corpus_pipeline.STAGES[-1][1](spark, odd, SF)
    assert packed.where("piece = 0").count() == len(ODD)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_clears_what_stages_leave(spark):
    import corpus_pipeline

    before = len(Scratch.opened)
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert len(Scratch.opened) <= before + 2  # its own and the last stage's


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    class Unset:
        def __getattr__(self, name):
            return self

        def __call__(self, *args):
            return self

        def isEmpty(self):
            return True

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "_jsc": Unset()})

    with pytest.raises(RuntimeError):
        common.shared_root(Session)
