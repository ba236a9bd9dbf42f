"""Units of source code in languages that have no parser here: a scanner that blanks out comments and strings and then finds
headers and the brackets, semicolons or line ends that close them. It forgives what does not parse."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

_NAME = r"[A-Za-z_$][\w$]*"
_COMMENTS = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_QUOTED = r'"(?:\\.|[^"\\\n])*"'
_CHAR = r"'(?:\\.|[^'\\\n])'"
_TICKED = r"`(?:\\.|[^`\\])*`"
#: What of each language holds no structure.
_HIDDEN = {
    "javascript": rf"{_COMMENTS}|{_QUOTED}|'(?:\\.|[^'\\\n])*'|{_TICKED}",
    "go": rf"{_COMMENTS}|{_QUOTED}|{_CHAR}|`[^`]*`",
    "rust": rf'{_COMMENTS}|r#*".*?"#*|{_QUOTED}|{_CHAR}',
    "csharp": rf'{_COMMENTS}|@"(?:""|[^"])*"|{_QUOTED}|{_CHAR}',
    "scala": rf'{_COMMENTS}|"""[\s\S]*?"""|{_QUOTED}|{_CHAR}',
}
_PLAIN = rf"{_COMMENTS}|{_QUOTED}|{_CHAR}"
#: Words that stand before `(...) {` without naming a unit.
_CONTROL = frozenset("if for while switch catch with return else do try synchronized using lock foreach match new throw when fixed sizeof function await typeof".split())


@dataclass(frozen=True)
class Header:
    """How a unit begins (its pattern at the start of a line, after modifiers) and how it ends: at the bracket that closes
    its `body`, or, where it may have none, at a semicolon or the end of its line. `named` headers are dropped if their
    group `n` is a word of control flow."""

    pattern: str
    body: str = "needed"  # needed, optional, or none
    named: bool = False


def _typed(modifiers: str) -> str:
    """A method in the manner of Java and C#: modifiers, a type, a name and its parameters."""
    return rf"(?:(?:{modifiers})\s+)*(?:<[^<>{{}};]*>\s*)?(?:[\w.<>\[\],?&]+\s+)+(?P<n>{_NAME})\s*(?:<[^<>(){{}}]*>)?\s*\([^(){{}};]*(?:\([^(){{}};]*\)[^(){{}};]*)*\)\s*(?:throws\s+[\w.,\s]+)?(?=\s*[{{;]|\s*=>)"


_JAVA = "public|private|protected|static|final|abstract|synchronized|native|default|strictfp"
_CSHARP = "public|private|protected|internal|static|sealed|abstract|virtual|override|async|partial|readonly|extern|unsafe|new"
_SCALA = "private|protected|final|override|implicit|abstract|sealed|lazy|case|inline"
_JS_EXPORT = r"(?:export\s+(?:default\s+)?)?"
_JAVASCRIPT = (
    Header(rf"{_JS_EXPORT}(?:async\s+)?function\s*\*?\s*(?:{_NAME})?\s*(?:<[^<>(){{}}]*>)?\s*(?=\()"),
    Header(rf"{_JS_EXPORT}(?:abstract\s+)?class\b"),
    Header(rf"{_JS_EXPORT}(?:const|let|var)\s+{_NAME}\s*(?::[^=;{{}}]+)?=\s*(?:async\s*)?(?:\([^(){{}}]*\)|{_NAME})\s*(?::\s*[^={{}};]+)?=>", "optional"),
    Header(rf"(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?\s*(?P<n>#?{_NAME})\s*(?:<[^<>(){{}}]*>)?\s*\([^(){{}};]*\)\s*(?::\s*[^{{}};=]+)?(?=\{{)", named=True),
    Header(r"export\b(?!\s+(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:function|class|const|let|var|interface|type|enum)\b)", "optional"),
)
UNITS: dict[str, tuple[Header, ...]] = {
    "javascript": _JAVASCRIPT,
    "typescript": (*_JAVASCRIPT, Header(rf"{_JS_EXPORT}(?:declare\s+)?interface\b"), Header(rf"{_JS_EXPORT}(?:declare\s+)?type\s+{_NAME}[^=;]*=", "none")),
    "java": (
        Header(rf"(?:(?:{_JAVA})\s+)*(?:class|interface|enum|record|@interface)\s+{_NAME}"),
        Header(_typed(_JAVA), "optional", True),
        Header(rf"(?:(?:public|private|protected)\s+)?(?P<n>{_NAME})\s*\([^(){{}};]*\)\s*(?:throws\s+[\w.,\s]+)?(?=\{{)", named=True),
    ),
    "csharp": (
        Header(rf"(?:(?:{_CSHARP})\s+)*(?:class|interface|struct|enum|record)\s+{_NAME}"),
        Header(_typed(_CSHARP), "optional", True),
    ),
    "scala": (
        Header(rf"(?:(?:{_SCALA})\s+)*(?:class|trait|object)\s+{_NAME}", "optional"),
        Header(rf"(?:(?:{_SCALA})\s+)*def\s+[^\s(\[:={{]+", "optional"),
    ),
    "cpp": (
        Header(rf"(?:template\s*<[^{{}};]*>\s*)?(?:class|struct)\s+(?:[\w:]+\s+)*{_NAME}[^(){{}};=]*(?=\{{)"),
        Header(r"(?:inline\s+)?namespace\b[^(){};=]*(?=\{)"),
        Header(r"(?:template\s*<[^{};]*>\s*)?(?:[\w:<>,&*~\[\]]+\s+[&*]*)*(?P<n>~?[\w:~]+|operator\s*[^\s(]+)\s*\([^(){};]*(?:\([^(){};]*\)[^(){};]*)*\)\s*(?:const|noexcept|override|final|\s)*(?::[^{};]*)?(?=\{)", named=True),
    ),
    "go": (
        Header(r"func\b"),
        Header(r"(?:type|var|const)\b", "optional"),
    ),
    "rust": (
        Header(r"(?:pub(?:\([^()]*\))?\s+)?(?:(?:async|const|unsafe|default|extern(?:\s+\"[^\"]*\")?)\s+)*fn\b", "optional"),
        Header(r"(?:pub(?:\([^()]*\))?\s+)?(?:unsafe\s+)?(?:impl|struct|enum|trait|mod)\b", "optional"),
    ),
}
_FOUND = {
    lang: [(re.compile(rf"^[ \t]*(?:@\w+(?:\([^()]*\))?\s+|#\[[^\]]*\]\s+)*(?P<unit>{h.pattern})", re.M), h) for h in headers] for lang, headers in UNITS.items()
}
_HIDES = {lang: re.compile(_HIDDEN.get("javascript" if lang == "typescript" else lang, _PLAIN), re.S) for lang in UNITS}
_OPEN, _CLOSE = "([{", ")]}"
_GOES_ON = re.compile(r"\s*[;=,)]")
#: Where a statement of C++ that is no declaration begins.
_NO_DECLARATION = re.compile(r"\s*(?:#|using\b|typedef\b|template\b|friend\b|return\b|namespace\b|(?:class|struct|enum|union)\b[^;=]*(?:\{|;)|(?:public|private|protected)\s*:|\Z)")


def bare(code: str, language: str) -> str:
    """The code with comments and strings blanked out; every character keeps its place."""
    return _HIDES[language].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)


def _closings(text: str) -> dict[int, int]:
    """The place of each bracket's partner; brackets without one close at the end."""
    out, open_ = {}, []
    for m in re.finditer(r"[()\[\]{}]", text):
        c = m[0]
        if c in _OPEN:
            open_.append(m.start())
        else:
            for k in range(len(open_) - 1, -1, -1):
                if text[open_[k]] == _OPEN[_CLOSE.index(c)]:
                    out[open_[k]] = m.start()
                    del open_[k:]
                    break
    return out | {at: len(text) - 1 for at in open_}


def _end(text: str, closing: dict[int, int], at: int, body: str) -> int | None:
    """Where a unit ends whose header has been read up to `at`: after its body, or, if it may do without, its statement."""
    while at < len(text):
        c = text[at]
        if c == "{" and body != "none":
            return closing[at] + 1
        if c in _OPEN:
            at = closing[at]
        elif c == ";" or c in _CLOSE:
            return at + (c == ";") if body != "needed" else None
        elif c == "\n" and body != "needed" and _statement_over(text, at):
            return at
        at += 1
    return len(text) if body != "needed" else None


def _statement_over(text: str, at: int) -> bool:
    before, after = text[max(0, at - 400) : at].rstrip()[-2:], text[at : at + 400].lstrip()[:1]
    return not (before[-1:] in ("=", ",", "+", "|", "&", "(", ":") or before == "=>" or after in ("{", "=", ".", "|", "&", "+", ":"))


def units(code: str, language: str) -> list[tuple[int, int]]:
    """(start, end) of every unit, outer ones before inner ones; inner ones count again."""
    text = bare(code, language)
    closing = _closings(text)
    found = set()
    for pattern, header in _FOUND[language]:
        for m in pattern.finditer(text):
            if header.named and m["n"] in _CONTROL:
                continue
            end = _end(text, closing, m.end("unit"), header.body)
            if end is not None:
                found.add((m.start("unit"), end))
    if language == "cpp":
        found |= _declarations(text, closing)
    return sorted(found, key=lambda s: (s[0], -s[1]))


def _declarations(text: str, closing: dict[int, int]) -> set[tuple[int, int]]:
    """Declarations of C and C++ outside of functions and classes: statements of the file and of its namespaces."""
    out = set()
    scopes = [(0, len(text))] + [(m.end(), closing[m.end() - 1]) for m in re.finditer(r"\bnamespace\b[^(){};=]*\{", text)]
    for start, end in scopes:
        begin = at = start
        while at < end:
            c = text[at]
            if c == "#" and not text[begin:at].strip():
                at = begin = text.find("\n", at) + 1 or end
                continue
            if c in _OPEN:
                at = closing[at]
                if c == "{" and not _GOES_ON.match(text, at + 1):
                    begin = at + 1
            elif c == ";":
                first = begin + len(text[begin:at]) - len(text[begin:at].lstrip())
                if not _NO_DECLARATION.match(text[first : at + 1]) and text[first:at].strip():
                    out.add((first, at + 1))
                begin = at + 1
            at += 1
    return out


def line_starts(code: str) -> list[int]:
    return [0] + [m.end() for m in re.finditer("\n", code)]


def unit_lines(code: str, language: str) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of every unit; the whole text if there is none."""
    starts = line_starts(code)
    out = [(bisect_right(starts, a), bisect_right(starts, max(a, b - 1)), code[a:b]) for a, b in units(code, language)]
    return out or [(1, len(starts), code)]


def uncovered(code: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Runs of lines that no span of lines covers, without blank lines and lines that are comments; such lines part runs."""
    out: list[tuple[int, int, str]] = []
    held: list[str] = []
    lines = code.split("\n")
    covered = [False] * (len(lines) + 2)
    for a, b in spans:
        covered[a : b + 1] = [True] * (min(b, len(lines)) - a + 1)
    for k, line in enumerate([*lines, ""], 1):
        bare_ = line.strip()
        if bare_ and not covered[k] and not bare_.startswith(("#", "//", "/*", "*")):
            held.append(line)
        elif held:
            out.append((k - len(held), k - 1, "\n".join(held)))
            held = []
    return out
