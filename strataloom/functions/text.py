"""Scalar text and path functions as column expressions (no Python workers)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that count as source code, and the languages that names stand for.
CODE_EXTENSIONS = (
    ".py", ".java", ".c", ".cpp", ".h", ".hpp", ".go", ".rs", ".cs", ".js", ".ts", ".sh", ".ps1", ".rb", ".php", ".swift", ".kt", ".scala",
    ".r", ".pl", ".lua", ".m", ".mm",
)
LANGUAGES = {
    "js": "javascript", "ts": "typescript", "tsx": "typescript", "jsx": "javascript", "py": "python", "c++": "cpp", "c": "cpp", "rs": "rust",
    "cs": "csharp",
}
MAIN_NAMES = "main|index|app|server|client|core|init|setup|config|start|run"
NO_TEXT = "无描述"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; `.tar.gz` counts as one; empty without one."""
    return F.regexp_extract(F.lower(basename(path)), r"(\.tar\.gz|\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?i)(\.tar\.gz|\.[^.]+)$", "")


def is_code(path: Column) -> Column:
    return extension(path).isin(*CODE_EXTENSIONS)


def slug(name: Column, default: Column | str = "file") -> Column:
    """Lower-case name of `a-z0-9_-` without its extension: other characters become `_`, runs of separators one `_`, ends
    are trimmed, at most 100 characters; the default where nothing is left."""
    base = F.regexp_replace(F.lower(stem(name)), r"[^a-z0-9_-]", "_")
    base = F.regexp_replace(F.regexp_replace(base, r"[_-]+", "_"), r"^_+|_+$", "")
    default = F.lit(default) if isinstance(default, str) else default
    return F.substring(F.when(F.coalesce(base, F.lit("")) == "", default).otherwise(base), 1, 100)


def encode_path(path: Column) -> Column:
    """Percent-encodes a path and keeps `/`; form encoding differs for the space, `*` and `~`."""
    whole = F.url_encode(path)
    for a, b in (("%2F", "/"), ("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        whole = F.replace(whole, F.lit(a), F.lit(b))
    return whole


def source_url(repo: Column, branch: Column, path: Column) -> Column:
    return F.concat_ws("/", F.rtrim(repo, F.lit("/")), F.lit("src/branch"), branch, encode_path(F.ltrim(path, F.lit("/"))))


def relative_path(path: Column, root: Column) -> Column:
    """Path below root with `/` as separator; paths elsewhere stay whole."""
    path, root = F.replace(path, F.lit("\\"), F.lit("/")), F.rtrim(F.replace(root, F.lit("\\"), F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).otherwise(path)


def as_pdf_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.(pptx|docx|doc)$", ".pdf")


def preview(text: Column, n: int, empty: str = NO_TEXT) -> Column:
    """First n characters and `...` if there are more; a stand-in for null or empty text."""
    cut = F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(empty)).otherwise(cut)


def shorten_middle(text: Column, n: int, mark: str = "\n...\n") -> Column:
    """Head and tail of a text that is longer than n."""
    half = n // 2
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, half), F.lit(mark), F.right(text, F.lit(half)))).otherwise(text)


def has_text(text: Column) -> Column:
    """Whether there is a character that is not white space, in any script."""
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def normal_language(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sorted(LANGUAGES.items()) for x in kv]), low), low)


def is_main_name(path: Column) -> Column:
    return F.lower(basename(path)).rlike(MAIN_NAMES)


def time_suffix(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def stable_id(kind: str, *parts: Column) -> Column:
    """An id from business keys: the same on every run and retry."""
    return F.concat(F.lit(kind + "-"), F.substring(F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256), 1, 32))


#: Scripts that are written without spaces between words.
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
#: Where they begin: characters below are told by their number, without a look at their script.
_FROM = r"\x{2E80}-\x{10FFFF}"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits. In scripts without spaces every two characters that stand together are a word,
    and one that stands alone; these come after the others."""
    low = F.lower(text)
    found = lambda pattern, group=0: F.regexp_extract_all(low, F.lit(pattern), F.lit(group))
    spaced = found(rf"[\p{{L}}\p{{N}}&&[^{_UNSPACED}]]+")
    pairs = found(rf"(?=([{_UNSPACED}]{{2}}))", 1)
    alone = found(rf"(?<![{_UNSPACED}])[{_UNSPACED}](?![{_UNSPACED}])")
    return F.when(low.rlike(f"[{_FROM}&&[{_UNSPACED}]]"), F.concat(spaced, pairs, alone)).otherwise(found(r"[\p{L}\p{N}]+"))


def fixed_windows(text: Column, size: int) -> Column:
    """Consecutive parts of `size` characters as an array; empty for empty text."""
    n = F.ceil(F.length(text) / F.lit(size)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, i * size + 1, F.lit(size)))
    return F.when(n > 0, parts).otherwise(F.array().cast("array<string>"))


def line_of(text: Column, part: Column) -> Column:
    """Line (from 1) on which part first stands in text; 1 if it doesn't."""
    at = F.instr(text, part)
    return F.when(at > 0, F.size(F.split(F.substr(text, F.lit(1), at - 1), "\n"))).otherwise(1)


def iso(value: Column, kind: str) -> Column:
    """Dates and timestamps as ISO text, other kinds as plain text."""
    form = {"date": "yyyy-MM-dd", "timestamp": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}.get(kind)
    return F.date_format(value, form) if form else value.cast("string")


def safe_json(value: Column) -> Column:
    """A struct, array or map as JSON that any reader takes: times as ISO text to the microsecond, dates as ISO text, binary as
    base64, also inside lists and objects; nulls keep their keys."""
    return F.to_json(value, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "dateFormat": "yyyy-MM-dd", "ignoreNullFields": "false"})


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null for zero vectors and unequal lengths. Each is divided by a power of two
    near its largest component first, so that no square overflows or vanishes; that rounds nothing."""
    add = lambda x, y: x + y
    zero = F.lit(0.0)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), zero, add))

    def bound(value: Column, then: Callable[[Column], Column]) -> Column:
        """then(value), with value computed once: inside a lambda it would be computed again for every element."""
        return F.transform(F.array(value), then)[0]

    def near_one(v: Column) -> Column:
        most = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
        scale = F.pow(F.lit(2.0), F.floor(F.log2(F.nullif(most, zero))))
        return bound(scale, lambda s: F.transform(v, lambda x: x.cast("double") / s))

    def of(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        both = norm(a) * norm(b)
        dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), zero, add)
        return F.when((F.size(a) == F.size(b)) & (both > 0), dot / both)

    return bound(F.struct(near_one(a).alias("a"), near_one(b).alias("b")), of)


def shorten(text: Column, n: int, mark: str = "...") -> Column:
    """The first n characters of a longer text, with a mark after them."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def folder_of(path: Column, base: str) -> Column:
    """A folder below base: paths that lie there as they are, others by their last name."""
    inside = (path == base) | F.startswith(path, F.lit(base.rstrip("/") + "/"))
    return F.when(inside, path).otherwise(F.concat_ws("/", F.lit(base.rstrip("/")), basename(F.rtrim(path, F.lit("/")))))


def lines_of(recognised: Column) -> Column:
    """Text of an OCR reply as JSON: a string, a list of strings or of objects with `text`, or an object with `text` or
    `lines`; lines are joined by line feeds. Null if it has none of these shapes or nothing in it."""
    of_list = lambda j: F.array_join(F.transform(F.from_json(j, "array<string>"), lambda x: F.coalesce(F.get_json_object(x, "$.text"), x)), "\n")
    lines = F.get_json_object(recognised, "$.lines")
    got = (
        F.when(recognised.rlike(r"^\s*\["), of_list(recognised))
        .when(lines.isNotNull(), of_list(lines))
        .when(recognised.rlike(r"^\s*\{"), F.get_json_object(recognised, "$.text"))
        .otherwise(F.regexp_replace(recognised, r'^\s*"|"\s*$', ""))
    )
    return F.when(F.trim(got) != "", got)
