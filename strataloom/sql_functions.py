"""The library's functions under names in SQL text: table functions for splitters, scalar ones for the rest.

register(spark) makes them known to a session:

    SELECT * FROM sl_text_chunks(TABLE(SELECT doc_id, text FROM documents), 'doc_id', 'text', 2048, 512)
    SELECT d.doc_id, w.pos, w.part FROM documents d, LATERAL sl_windows(d.text, 500) w
    SELECT sl_cosine(a.embedding, b.embedding), sl_words(text), sl_slug(name), sl_source_url(...)
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import IntegerType, StringType, StructType

from .functions import chunking
from .functions.providers import Providers
from .runtime import ship


def _table_column(rows: AnalyzeArgument, name: AnalyzeArgument, what: str):
    """The field of a table argument that a constant argument names."""
    if not rows.isTable:
        raise ValueError("the first argument is TABLE(...)")
    if not name.isConstantExpression or not isinstance(name.value, str):
        raise ValueError(f"{what} is the name of a column, as a constant")
    kinds = {f.name: f for f in rows.dataType.fields}
    if name.value not in kinds:
        raise ValueError(f"no column {name.value} for {what}; there are {', '.join(kinds)}")
    return kinds[name.value]


def _whole(argument: AnalyzeArgument | None, what: str, least: int) -> None:
    if argument is not None and (not argument.isConstantExpression or not isinstance(argument.value, int) or argument.value < least):
        raise ValueError(f"{what} is a whole number of {least} or more, as a constant")


class TextChunks:
    """(key, chunk_number, chunk) of each row's text by the recursive splitter; null and blank texts give none. The key has
    the type it has in the table."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        own = _table_column(rows, key, "key")
        if not isinstance(_table_column(rows, text, "text").dataType, StringType):
            raise ValueError("text is a column of strings")
        _whole(size, "size", 1), _whole(overlap, "overlap", 0)
        return AnalyzeResult(StructType().add(own.name, own.dataType).add("chunk_number", IntegerType()).add("chunk", StringType()))

    def eval(self, row: Row, key: str, text: str, size: int = 2048, overlap: int = 512) -> Iterator[tuple]:
        if isinstance(row[text], str):
            for i, chunk in enumerate(chunking.recursive(row[text], size, overlap)):
                yield row[key], i, chunk


class CodeChunks:
    """(key, chunk_number, start_line, end_line, language, chunk) of each row's code, by units where the language has them."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, code: AnalyzeArgument, language: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        own = _table_column(rows, key, "key")
        _table_column(rows, code, "code"), _table_column(rows, language, "language")
        _whole(size, "size", 1), _whole(overlap, "overlap", 0)
        kinds = StructType().add(own.name, own.dataType).add("chunk_number", IntegerType()).add("start_line", IntegerType()).add("end_line", IntegerType())
        return AnalyzeResult(kinds.add("language", StringType()).add("chunk", StringType()))

    def eval(self, row: Row, key: str, code: str, language: str, size: int = chunking.CHUNK, overlap: int = chunking.OVERLAP) -> Iterator[tuple]:
        if isinstance(row[code], str) and row[code].strip():
            for i, (a, b, chunk) in enumerate(chunking.split_code(row[code], row[language], size, overlap)):
                yield row[key], i, a, b, row[language], chunk


class Windows:
    """(pos, part): consecutive parts of `size` characters, to be joined LATERAL."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        _whole(size, "size", 1)
        return AnalyzeResult(StructType().add("pos", IntegerType()).add("part", StringType()))

    def eval(self, text: str | None, size: int) -> Iterator[tuple]:
        for pos in range(0, len(text or ""), size):
            yield pos // size, text[pos : pos + size]


#: Functions in SQL itself, which the optimizer puts in their place: (arguments, result, body). Fixed wording of the same
#: functions in functions/text.py.
EXPRESSIONS = {
    "sl_cosine": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / (sqrt(aggregate(transform(a, x -> x * x), 0D, (s, x) -> s + x)) * sqrt(aggregate(transform(b, x -> x * x), 0D, (s, x) -> s + x)))",
    ),
    "sl_words": ("t STRING", "ARRAY<STRING>", r"regexp_extract_all(lower(t), r'[\p{L}\p{N}]+', 0)"),
    "sl_base_name": ("path STRING", "STRING", r"regexp_extract(path, r'[^/]*$', 0)"),
    "sl_preview": ("t STRING, n INT", "STRING", "CASE WHEN length(t) > n THEN concat(substr(t, 1, n), '...') ELSE t END"),
}


def register(spark: SparkSession, providers: Providers | None = None) -> list[str]:
    """Makes all functions known to a session, and those of the providers: sl_embed, sl_expand, sl_describe (text ->) and
    sl_relevance (query, text ->). Gives the names."""
    ship(spark)
    tables = {"sl_text_chunks": TextChunks, "sl_code_chunks": CodeChunks, "sl_windows": Windows}
    for name, kind in tables.items():
        spark.udtf.register(name, F.udtf(kind))
    for name, (arguments, result, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    p = providers or Providers()

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: p.embed(t) if isinstance(t, str) else None)

    @F.pandas_udf("string")
    def expand(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: p.expand(t) if isinstance(t, str) else None)

    @F.pandas_udf("string")
    def describe(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: p.describe(t) if isinstance(t, str) else None)

    @F.pandas_udf("double")
    def relevance(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([p.rerank(q, t) if isinstance(q, str) and isinstance(t, str) else None for q, t in zip(queries, texts)], dtype="float64")

    scalar = {"sl_embed": embed, "sl_expand": expand, "sl_describe": describe, "sl_relevance": relevance}
    for name, f in scalar.items():
        spark.udf.register(name, f)
    return [*tables, *EXPRESSIONS, *scalar]
