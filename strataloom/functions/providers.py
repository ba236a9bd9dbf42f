"""Model-backed steps behind plain functions. The defaults work offline and always give the same answer."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .parsing import REQUIRED, find_json
from .text import shorten

DIM = 64
#: What a prompt may hold of a project's tree and of its main files.
TREE_CHARS, CODE_CHARS = 15_000, 30_000


def hash_embedding(text: str, dim: int = DIM) -> list[float] | None:
    """Signed feature hashing of lower-cased words, length one; None for text without a word."""
    v = np.zeros(dim)
    for w in re.findall(r"\w+", text.lower()):
        h = zlib.crc32(w.encode())
        v[h % dim] += 1 if h & 0x10000 else -1
    n = float(np.sqrt((v * v).sum()))
    return (v / n).tolist() if n else None


def overlap_score(query: str, text: str) -> float:
    """Share of the query's words that the text holds."""
    q = set(re.findall(r"\w+", query.lower()))
    return len(q & set(re.findall(r"\w+", text.lower()))) / len(q) if q else 0.0


def first_sentences(text: str, most: int = 100) -> str:
    """Whole sentences from the start while they fit, else the cut text."""
    taken = ""
    for s in re.split(r"(?<=[.!?])\s+", text.strip()[:2000]):
        if taken and len(taken) + 1 + len(s) > most:
            break
        taken = f"{taken} {s}".strip()
    return taken[:most]


@dataclass(frozen=True)
class Providers:
    """Swap any of these for calls to a real model; each gets and gives plain Python values and None for a failure."""

    embed: Callable[[str], list[float] | None] = hash_embedding
    rerank: Callable[[str, str], float] = overlap_score
    expand: Callable[[str], str] = str
    describe: Callable[[str], str] = first_sentences
    label: Callable[[str], list[dict]] = field(default=lambda text: [])
    fallback: Callable[[str], list[float] | None] | None = None
    ask: Callable[[str], str] | None = None
    judge: Callable[[str], bool] = field(default=lambda image: False)
    read: tuple[Callable[[str], str], ...] = ()
    route: Callable[[str], str] | None = None

    def embedding(self, text: Column) -> Column:
        ship(SparkSession.active())

        @F.pandas_udf("array<double>")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: _safe(self.embed, t) or _safe(self.fallback, t))

        return run(text)

    def relevance(self, query: Column, text: Column) -> Column:
        ship(SparkSession.active())

        @F.pandas_udf("double")
        def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
            return pd.Series([_safe(self.rerank, q, t) for q, t in zip(queries, texts)], dtype="float64")

        return run(query, text)

    def expansion(self, query: Column) -> Column:
        return self._text(self.expand, query)

    def description(self, text: Column) -> Column:
        return self._text(self.describe, text)

    @staticmethod
    def _text(call: Callable[[str], str], column: Column) -> Column:
        ship(SparkSession.active())

        @F.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: _safe(call, t))

        return run(column)

    def strategy(self, question: Column) -> Column:
        """The way that a question is to be answered; null leaves it to the default."""
        return F.lit(None).cast("string") if self.route is None else self._text(self.route, question)

    def relevant_image(self, image: Column) -> Column:
        """Whether an image is to be kept; a failed call counts as no."""
        ship(SparkSession.active())

        @F.pandas_udf("boolean")
        def run(images: pd.Series) -> pd.Series:
            return images.map(lambda x: bool(_safe(self.judge, x)))

        return run(image)

    def recognised(self, image: Column) -> Column:
        """Text of an image by the first of the readers that gives one; later ones are asked only for what is left."""
        ship(SparkSession.active())
        readers = list(dict.fromkeys(self.read))

        @F.pandas_udf("string")
        def run(images: pd.Series) -> pd.Series:
            return images.map(lambda x: next((t for r in readers if (t := _safe(r, x)) and t.strip()), None))

        return run(image)

    def task(self, prompt: Column, kind: str) -> Column:
        """struct(status, payload, error): the model's reply to a prompt as JSON that has the keys of its kind. Status is
        success only then; a failed call, a reply without JSON and one of another shape say so in `error`."""
        ship(SparkSession.active())
        need = REQUIRED[kind]

        @F.pandas_udf("struct<status:string,payload:string,error:string>")
        def run(prompts: pd.Series) -> pd.DataFrame:
            rows = []
            for p in prompts:
                reply = _safe(self.ask, p)
                found = find_json(reply, need[0]) if reply else None
                error = "no reply" if not reply else "no json" if found is None else None if found[0] == "{" and set(need) <= set(json.loads(found)) else "wrong shape"
                rows.append(("success" if error is None else "failed", found if error is None else None, error))
            return pd.DataFrame(rows, columns=["status", "payload", "error"])

        return run(prompt)

    def labels(self, text: Column) -> Column:
        ship(SparkSession.active())

        @F.pandas_udf("struct<status:string,labels:array<struct<label_id:string,relevance:double,evidence:string>>>")
        def run(texts: pd.Series) -> pd.DataFrame:
            got = [_safe(self.label, t) for t in texts]
            return pd.DataFrame({"status": ["success" if g is not None else "failed" for g in got], "labels": [g or [] for g in got]})

        return run(text)


def _safe(call, *args):
    """The call's result; None for null arguments and for any failure, which is a state of the row and not of the job."""
    if call is None or any(not isinstance(a, str) for a in args):
        return None
    try:
        return call(*args)
    except Exception:
        return None


_REGISTRY: dict[str, Providers] = {}


def register(name: str, providers: Providers) -> None:
    _REGISTRY[name] = providers


def registered(name: str | None = None) -> Providers:
    """The providers of that name; the offline ones for None. An unknown name is an error."""
    return Providers() if name is None else _REGISTRY[name]


def prompt(task: str, **given: Column) -> Column:
    """A model's task with what it is given: a line for the task, then one JSON object of the columns; nulls are left out."""
    return F.concat(F.lit(f"{task}\n"), F.to_json(F.struct(*[c.alias(k) for k, c in sorted(given.items())])))


def project_prompt(task: str, name: Column, summary: Column, readme: Column, code: Column, tree: Column) -> Column:
    """What a model is told of a project: its README where there is no summary, its tree where there is no main code."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return prompt(
        task, software_name=name, summary=F.when(blank(summary), readme).otherwise(summary),
        file_code=F.when(blank(code), shorten(tree, TREE_CHARS)).otherwise(shorten(code, CODE_CHARS)),
    )
