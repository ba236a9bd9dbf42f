"""Splitters of source code and text as row generators (one Arrow pass, no shuffle)."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..runtime import ship
from . import units

CHUNK, OVERLAP = 2500, 300
#: Kinds of Python definitions that are units of their own; nested ones count again.
UNITS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def python_units(code: str) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of every definition, outer ones before inner ones; the whole text if there is none or
    it can't be parsed."""
    lines = code.split("\n")
    try:
        found = [n for n in ast.walk(ast.parse(code)) if isinstance(n, UNITS)]
    except (SyntaxError, ValueError, RecursionError):
        found = []
    spans = sorted((min([n.lineno, *(d.lineno for d in n.decorator_list)]), -n.end_lineno) for n in found)
    if not spans:
        return [(1, len(lines), code)]
    return [(a, -b, "\n".join(lines[a - 1 : -b])) for a, b in spans]


def by_lines(text: str, first: int = 1, size: int = CHUNK) -> list[tuple[int, int, str]]:
    """Runs of whole lines of at most `size` characters; a longer line is cut at `size`."""
    out: list[tuple[int, int, str]] = []
    held: list[str] = []
    begin, used = first, 0
    for k, line in enumerate(text.split("\n"), first):
        if held and used + len(line) + 1 > size:
            out.append((begin, k - 1, "\n".join(held)))
            held, used, begin = [], 0, k
        if len(line) > size:
            out += [(k, k, line[i : i + size]) for i in range(0, len(line), size)]
            begin = k + 1
        else:
            held.append(line)
            used += len(line) + 1
    if held:
        out.append((begin, begin + len(held) - 1, "\n".join(held)))
    return out


def with_overlap(parts: list[tuple[int, int, str]], overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """Each part but the first gets the end of the one before it; its first line moves accordingly."""
    out = parts[:1]
    for (_, end, before), (a, b, own) in zip(parts, parts[1:]):
        tail = before[-overlap:] if overlap else ""
        out.append((end - tail.count("\n"), b, f"{tail}\n{own}") if tail else (a, b, own))
    return out


def recursive(text: str, size: int = CHUNK, overlap: int = OVERLAP, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Splits at the first separator that occurs, then what is still too long at the next ones, and joins neighbours up to
    `size` with up to `overlap` characters repeated."""
    mark = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(mark) + 1 :] or ("",)
    pieces = [text[i : i + size] for i in range(0, len(text), size)] if mark == "" else text.split(mark)
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        if held and (joined := mark.join(held)).strip():
            out.append(joined)

    for p in pieces:
        if len(p) > size:
            close()
            held = []
            out += recursive(p, size, overlap, rest)
            continue
        if held and len(mark.join([*held, p])) > size:
            close()
            while held and (len(mark.join(held)) > overlap or len(mark.join([*held, p])) > size):
                held = held[1:]
        held.append(p)
    close()
    return out


#: Where texts of a language part before they part at paragraphs: each keeps what it begins with.
_TYPES, _BLOCKS = ("\nclass ", "\ninterface ", "\nenum "), ("\nif ", "\nfor ", "\nwhile ", "\nswitch ")
SEPARATORS: dict[str, tuple[str, ...]] = {
    "python": ("\nclass ", "\ndef ", "\n    def "),
    "javascript": ("\nclass ", "\nfunction ", "\nconst ", "\nlet ", "\nvar ", *_BLOCKS),
    "java": (*_TYPES, "\n    public ", "\n    private ", "\n    protected ", *_BLOCKS),
    "cpp": ("\nclass ", "\nstruct ", "\nnamespace ", "\nvoid ", "\nint ", "\nstatic ", *_BLOCKS),
    "go": ("\nfunc ", "\ntype ", "\nvar ", "\nconst "),
    "rust": ("\nfn ", "\npub ", "\nimpl ", "\nstruct ", "\nenum ", "\nmod "),
    "php": ("\nclass ", "\nfunction ", *_BLOCKS),
    "ruby": ("\nclass ", "\nmodule ", "\ndef ", "\n  def "),
    "swift": ("\nclass ", "\nstruct ", "\nenum ", "\nextension ", "\nfunc "),
    "scala": ("\nclass ", "\nobject ", "\ntrait ", "\ndef ", "\nval "),
    "html": ("<body", "<section", "<div", "<table", "<ul", "<p", "<li", "<h1", "<h2", "<h3"),
    "markdown": ("\n# ", "\n## ", "\n### ", "\n#### ", "\n---\n"),
    "latex": ("\n\\chapter{", "\n\\section{", "\n\\subsection{", "\n\\begin{"),
}
#: Other names of these, and of languages whose texts part alike.
ALSO = {"typescript": "javascript", "csharp": "java", "c": "cpp", "md": "markdown", "tex": "latex", "rb": "ruby", "kotlin": "java"}


def by_separators(text: str, language: str | None, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(first line, last line, text): the recursive splitter with the language's own separators first."""
    own = SEPARATORS.get(ALSO.get(language or "", language or ""), ())
    out, at = [], 0
    for part in _at_starts(text, own, size) if own else [text]:
        cut = [part] if len(part) <= size else recursive(part, size, overlap)
        for c in cut:
            first = text.find(c, max(0, at - overlap - 1))
            first = at if first < 0 else first
            line = text.count("\n", 0, first) + 1
            if c.strip():
                out.append((line, line + c.rstrip("\n").count("\n"), c))
            at = first + len(c)
    return out


def _at_starts(text: str, separators: tuple[str, ...], size: int) -> list[str]:
    """The text parted before every separator that is needed to get below `size`, neighbours joined up to it."""
    if len(text) <= size or not separators:
        return [text]
    cuts = [0, *(m.start() for m in re.finditer(re.escape(separators[0]), text) if m.start()), len(text)]
    parts = [x for a, b in zip(cuts, cuts[1:]) for x in _at_starts(text[a:b], separators[1:], size)]
    out = parts[:1]
    for p in parts[1:]:
        if len(out[-1]) + len(p) <= size:
            out[-1] += p
        else:
            out.append(p)
    return out


def split_code(code: str, language: str | None, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """Units of Python and of the languages that units.UNITS knows, long ones cut by lines with overlap; texts of other
    languages by the recursive splitter."""
    known = "cpp" if language == "c" else language
    if known != "python" and known not in units.UNITS:
        return by_separators(code, language, size, overlap)
    out = []
    for a, b, unit in python_units(code) if known == "python" else units.unit_lines(code, known):
        out += [(a, b, unit)] if len(unit) <= size else with_overlap(by_lines(unit, a, size), overlap)
    return out


def not_in_units(code: str, language: str | None) -> list[tuple[int, int, str]]:
    """Runs of lines outside of all units: imports, globals, main code; nothing for languages without units."""
    known = "cpp" if language == "c" else language
    if known != "python" and known not in units.UNITS:
        return []
    found = python_units(code) if known == "python" else units.unit_lines(code, known)
    whole = len(found) == 1 and found[0][2] == code
    return units.uncovered(code, [] if whole else [(a, b) for a, b, _ in found])


Splitter = Callable[[str, str | None], list[tuple[int, int, str]]]


def chunk_files(
    files: DataFrame, key: str = "path", code: str = "content", language: str = "language", size: int = CHUNK, overlap: int = OVERLAP,
    splitter: Splitter | None = None, keep_failed: bool = False,
) -> DataFrame:
    """(key, chunk_number, start_line, end_line, language, chunk) for each file; null and blank files give none. `splitter`
    takes the place of split_code(). With keep_failed a file that can't be cut gives one row, without a chunk, and every row
    has `status` (success, failed) and `error`; without, its error is raised."""
    cut = splitter or (lambda body, lang: split_code(body, lang, size, overlap))

    def rows_of(k, body, lang) -> list[tuple]:
        try:
            return [(k, i, a, b, lang, text, "success", None) for i, (a, b, text) in enumerate(cut(body, lang))]
        except Exception as e:
            if not keep_failed:
                raise
            return [(k, None, None, None, lang, None, "failed", f"{type(e).__name__}: {e}"[:500])]

    names = [key, "chunk_number", "start_line", "end_line", "language", "chunk", *(["status", "error"] if keep_failed else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for k, body, lang in zip(pdf[key], pdf[code], pdf[language]) if isinstance(body, str) and body.strip() for r in rows_of(k, body, lang)]
            out = pd.DataFrame([r[: len(names)] for r in rows], columns=names)
            yield out.astype({c: "Int32" for c in names[1:4]})

    ship(files.sparkSession)
    schema = f"{key} {dict(files.dtypes)[key]}, chunk_number int, start_line int, end_line int, language string, chunk string"
    return files.select(key, code, language).mapInPandas(run, schema + (", status string, error string" if keep_failed else ""))


def chunk_texts(docs: DataFrame, key: str, text: str, size: int = 2048, overlap: int = 512) -> DataFrame:
    """(key, chunk_number, chunk) by the recursive splitter; null and blank texts give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, c) for k, body in zip(pdf[key], pdf[text]) if isinstance(body, str) for i, c in enumerate(recursive(body, size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "chunk_number", "chunk"])

    ship(docs.sparkSession)
    return docs.select(key, text).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, chunk_number int, chunk string")
