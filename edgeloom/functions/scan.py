"""Source-text scanners that need state: code lines and documentation comments, over Arrow batches."""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.types import IntegerType, StringType

_HOLES = regex.compile(
    r"""(?P<comment>(?P<c>\(\*(?:(?!\(\*|\*\))(?s:.)|(?&c))*+(?:\*\)|\Z)))
      | (?P<text>"(?:\\[^\n]|[^"])*+(?:"|\Z))
      | (?P<quoted>\{(?P<id>[a-zA-Z0-9_]*)\|(?s:.)*?(?:\|(?P=id)\}|\Z))""",
    regex.VERBOSE,
)


def _blank(m: regex.Match) -> str:
    """Only the opening of a string is code; comments are not; line breaks stay."""
    return ("" if m.group("comment") is not None else "x") + "\n" * m.group().count("\n")


def code_lines(source: str | None) -> int | None:
    """Lines with code: comments nest, and a line wholly inside a longer string does not count."""
    if source is None:
        return None
    return sum(1 for line in _HOLES.sub(_blank, source).split("\n") if line.strip(" \t\r"))


def _undecorated(block: str) -> str:
    blanks = " \t\n\r\f"
    s = block.strip(blanks)
    for opening, closing in (("(*", "*)"), ("/*", "*/")):
        if s.startswith(opening + "*") and len(s) > len(opening):
            s = s[len(opening) + 1 :]
        elif s.startswith(opening):
            s = s[len(opening) :]
        s = s.removesuffix(closing)
    out = []
    for line in s.split("\n"):
        line = line.strip(blanks)
        out.append(line[1:].strip(blanks) if line.startswith("*") else line)
    return "\n".join(out).strip(blanks)


REACH = 20


def doc_comment(source: str | None, line_start: int | None, path: str | None) -> str | None:
    """The comment that ends above a line, at most 20 lines up: a ``(* *)`` block, or ``///`` lines; by file extension."""
    if source is None or not line_start or line_start <= 0:
        return None
    rows = source.split("\n")
    end = min(line_start - 1, len(rows) - 1)
    first = max(0, end - REACH)
    above = range(max(0, end - 1), first - 1, -1)

    def block() -> str | None:
        close = next((i for i in above if rows[i].strip()), None)
        if close is None or not rows[close].strip().endswith("*)"):
            return None
        start = next((i for i in range(close, first - 1, -1) if "(*" in rows[i]), None)
        return None if start is None else _undecorated("\n".join(rows[start : close + 1]))

    def slashes() -> str | None:
        got = []
        for i in above:
            line = rows[i].strip()
            if line.startswith("///"):
                got.append(line[3:].strip())
            elif line:
                break
        return "\n".join(reversed(got)) if got else None

    if (path or "").endswith(".rs"):
        return slashes()
    if (path or "").endswith((".ml", ".mli")):
        return block()
    found = block()
    return slashes() if found is None else found


@arrow_udf(IntegerType())
def count_code_lines(source: pa.Array) -> pa.Array:
    return pa.array([code_lines(s) for s in source.to_pylist()], pa.int32())


@arrow_udf(StringType())
def find_doc_comment(source: pa.Array, line_start: pa.Array, path: pa.Array) -> pa.Array:
    return pa.array([doc_comment(*x) for x in zip(source.to_pylist(), line_start.to_pylist(), path.to_pylist())], pa.string())
