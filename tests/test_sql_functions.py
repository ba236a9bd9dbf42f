"""The library's functions in SQL text against the same in the DataFrame API."""

import pytest
from pyspark.sql import functions as F

from strataloom import sql_functions
from strataloom.functions import chunking, text
from strataloom.functions.providers import Providers, hash_embedding, overlap_score
from strataloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def known(spark):
    assert len(sql_functions.register(spark, Providers(expand=lambda q: q + "?"))) == 11
    return spark


def test_chunks_are_those_of_the_plan(known):
    got = catalog.queries()["text_chunks_in_sql"](known, SF)
    want = catalog.queries()["text_chunks"](known, SF)
    docs = known.read.parquet(f"{SF}/documents.parquet")
    plain = chunking.chunk_texts(docs, "doc_id", "text")
    assert got.schema == plain.schema and want.count() > 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_code_chunks_keep_their_key(known):
    code = "import os\n\ndef f(x):\n    return x\n\nclass A:\n    def g(self):\n        return 1\n"
    known.createDataFrame([("a.py", code, "python"), ("b.py", None, "python"), ("c", "plain words", "text")], "path string, code string, lang string").createOrReplaceTempView("sl_files")
    got = known.sql("SELECT * FROM sl_code_chunks(TABLE(sl_files), 'path', 'code', 'lang', 2500, 300)").collect()
    want = [(k, i, a, b, lang, c) for k, body, lang in (("a.py", code, "python"), ("c", "plain words", "text")) for i, (a, b, c) in enumerate(chunking.split_code(body, lang))]
    assert sorted(map(tuple, got)) == sorted(want)


def test_scalar_functions(known):
    sql_functions.register(known, Providers(expand=lambda q: q + "?"))
    row = known.sql("""SELECT sl_cosine(array(1D, 2D), array(2D, 1D)) AS c, sl_words('Ab é-9 x') AS w, sl_base_name('a/b/c.txt') AS b, sl_preview('abcdef', 3) AS p,
      sl_embed('some words') AS e, sl_expand('what') AS q, sl_describe(null) AS d, sl_relevance('a b', 'b c') AS r""").first()
    assert row["c"] == pytest.approx(0.8) and row["w"] == ["ab", "é", "9", "x"] and (row["b"], row["p"]) == ("c.txt", "abc...")
    assert row["e"] == pytest.approx(hash_embedding("some words")) and (row["q"], row["d"], row["r"]) == ("what?", None, overlap_score("a b", "b c"))
    rows = known.createDataFrame([("Ab é-9 x", "a/b/c.txt")], "t string, path string")
    assert rows.select(text.words(F.col("t")).alias("w"), text.basename(F.col("path")).alias("b")).first() == (row["w"], row["b"])


@pytest.mark.parametrize("call", ["TABLE(sl_files), 'nokey', 'code'", "TABLE(sl_files), 'path', path", "TABLE(sl_files), 'path', 'code', 0", "'x', 'path', 'code'"])
def test_wrong_arguments_are_told_at_once(known, call):
    known.createDataFrame([("a", "b")], "path string, code string").createOrReplaceTempView("sl_files")
    with pytest.raises(Exception):
        known.sql(f"SELECT * FROM sl_text_chunks({call})").collect()
