"""Tolerant extraction of JSON from model replies, and checks of its shape. Vectorised; the control flow needs Python."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

_FENCED = re.compile(r"```(?:json|JSON)?\s*(.*?)```", re.S)
_STRING_OR_COMMENT = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)
_LAST_COMMA = re.compile(r'"(?:\\.|[^"\\])*"|,(?=\s*[}\]])', re.S)

REQUIRED = {
    "summary": ("summary", "files"),
    "tactics": ("tactics",),
    "technique": ("result", "ttps"),
    "main_files": ("main_files",),
}


def balanced(text: str, start: int) -> str | None:
    """The object that opens at `start`, with braces inside strings left out of the count."""
    depth, inside, skip = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif inside:
            skip, inside = c == "\\", c != '"'
        elif c == '"':
            inside = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return text[start : i + 1]
    return None


def _load(text: str) -> str | None:
    plain = _STRING_OR_COMMENT.sub(lambda m: m[0] if m[0][0] == '"' else "", text)
    for attempt in (text, plain, _LAST_COMMA.sub(lambda m: m[0] if m[0][0] == '"' else "", plain)):
        try:
            return json.dumps(json.loads(attempt), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            continue
    return None


def find_json(reply: str | None, marker: str | None = None) -> str | None:
    """The first JSON value that can be made out: in a fence, as the whole text, as the object around `marker`, or
    from the first brace to the last. Comments outside strings and trailing commas are forgiven. None if there is none."""
    if not reply or not reply.strip():
        return None
    tries = [m.strip() for m in _FENCED.findall(reply)] + [reply.strip()]
    if marker and (at := reply.find(f'"{marker}"')) >= 0:
        for start in [m.start() for m in re.finditer(r"\{", reply[:at])][::-1]:
            if (got := balanced(reply, start)) and start + len(got) > at:
                tries.append(got)
                break
    if (start := reply.find("{")) >= 0:
        tries.append(balanced(reply, start) or "")
        tries.append(reply[start : reply.rfind("}") + 1])
    return next((got for t in tries if t and (got := _load(t)) and got[0] in "{["), None)


def extract_json(reply: Column, marker: str | None = None) -> Column:
    """JSON text found in a reply, null if there is none."""

    ship(SparkSession.active())

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: find_json(t, marker) if isinstance(t, str) else None)

    return run(reply)


def is_valid(text: Column, kind: str) -> Column:
    """Whether JSON text has every key that its kind requires."""
    keys = F.json_object_keys(text)
    need = F.array(*[F.lit(k) for k in REQUIRED[kind]])
    return F.coalesce(F.size(F.array_except(need, keys)) == 0, F.lit(False))


def between_braces(reply: Column) -> Column:
    """From the first `{` to the last `}`, without Python; null if there is no such span."""
    first = F.instr(reply, "{")
    last = F.length(reply) - F.instr(F.reverse(reply), "}") + 1
    return F.when((first > 0) & (F.instr(reply, "}") > 0) & (last > first), F.substr(reply, first, last - first + 1))
