"""Small text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = " \\t\\n\\r\\f"


def strip(c: Column) -> Column:
    """Without blanks, tabs, line breaks and form feeds at both ends (Spark's trim takes blanks only)."""
    return F.regexp_replace(c, f"^[{_BLANKS}]+|[{_BLANKS}]+\\z", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def line_range(c: Column, first: Column, last: Column) -> Column:
    """Lines ``first``..``last`` of a text, counted from 1; fewer if the text ends before, none if it is null."""
    start = F.greatest(first, F.lit(1))
    return F.when(c.isNull() | (last < start), F.array().cast("array<string>")).otherwise(F.slice(lines(c), start, F.greatest(last - start + 1, F.lit(0))))


def body_digest(c: Column) -> Column:
    """MD5 of the text without blank lines and without blanks at the ends of lines."""
    return F.md5(F.array_join(F.filter(F.transform(lines(c), strip), lambda x: x != ""), "\n"))


def last_segments(c: Column, n: int, dot: str = ".") -> Column:
    return F.substring_index(c, dot, -n)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def capitalized(c: Column) -> Column:
    """First letter in upper case, ASCII only, the rest as it is."""
    return F.concat(F.translate(F.substring(c, 1, 1), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(c, 2, 2_000_000_000))


def module_of(path: Column) -> Column:
    """The capitalised base name of a source path: what qualified names call the file."""
    return capitalized(without_extension(base_name(path)))


def call_site(path: Column, line: Column) -> Column:
    return F.concat_ws(":", path, line.cast("string"))


def strip_scheme(uri: Column) -> Column:
    return F.regexp_replace(uri, "^file://", "")


def relative_to(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 2_000_000_000)).otherwise(path)


def list_or_scalar(c: Column) -> Column:
    """``[a, b]`` or ``a, b`` as an array of trimmed, non-empty strings, quotes kept; null gives an empty array."""
    bare = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?s)^\[(.*)\]\z", "$1")
    return F.filter(F.transform(F.split(bare, ","), strip), lambda x: x != "")


def unquoted(c: Column) -> Column:
    """Trimmed, then without one pair of equal quotes around all of it."""
    return F.regexp_replace(strip(c), r"""(?s)^(["'])(.*)\1\z""", "$2")


def list_items(c: Column) -> Column:
    """``[a, "b"]`` as its unquoted items, ``a, b`` or ``"a, b"`` as its trimmed parts, none of them empty; null gives an empty array."""
    s = strip(F.coalesce(c, F.lit("")))
    listed = F.transform(F.split(F.substr(s, F.lit(2), F.char_length(s) - 2), ","), unquoted)
    parts = F.when((F.char_length(s) >= 2) & s.startswith("["), listed).otherwise(F.transform(F.split(unquoted(s), ","), strip))
    return F.filter(parts, lambda x: x != "")


def encode_value_touched(entries: Column) -> Column:
    """``[{"kind":"k","direction":"d"},...]`` of an array of (kind, direction), nothing escaped; empty gives null."""
    one = F.transform(entries, lambda e: F.concat(F.lit('{"kind":"'), e["kind"], F.lit('","direction":"'), e["direction"], F.lit('"}')))
    return F.when(F.size(entries) > 0, F.concat(F.lit("["), F.array_join(one, ","), F.lit("]")))


def parse_value_touched(c: Column) -> Column:
    """(kind, direction) of every brace object of the text that has both; anything between objects is skipped."""
    def field(o: Column, name: str) -> Column:
        return F.regexp_extract(o, rf'["\']?{name}["\']?\s*:\s*["\']?([^"\',}}]*)', 1)

    objects = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\{([^{}]*)\}"), F.lit(0))
    both = F.transform(objects, lambda o: F.struct(strip(field(o, "kind")).alias("kind"), strip(field(o, "direction")).alias("direction")))
    return F.filter(both, lambda e: (e["kind"] != "") & (e["direction"] != ""))


def lambda_root(name: Column) -> Column:
    """The named function a lambda name hangs under: all from the first ``.<fun:`` is cut."""
    return F.regexp_replace(name, r"\.<fun:.*$", "")


def enum_or_null(c: Column, allowed: tuple[str, ...]) -> Column:
    return F.when(c.isin(*allowed), c)


#: Symbol kinds of the language-server protocol, 1 first.
SYMBOL_KINDS = (
    "File", "Module", "Namespace", "Package", "Class", "Method", "Property", "Field", "Constructor", "Enum", "Interface", "Function", "Variable",
    "Constant", "String", "Number", "Boolean", "Array", "Object", "Key", "Null", "EnumMember", "Struct", "Event", "Operator", "TypeParameter",
)


def symbol_kind(c: Column) -> Column:
    return F.when((c >= 1) & (c <= len(SYMBOL_KINDS)), F.element_at(F.array(*map(F.lit, SYMBOL_KINDS)), c.cast("int")))
