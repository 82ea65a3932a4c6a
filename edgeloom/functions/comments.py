"""Documentation comments: sections between tags, their entries, and two quality scores, all as column expressions.

Two dialects are known. ``index``: ``{tag}`` sections only, eight tags, ``(none)`` stands for "none" everywhere. ``lsp``:
``@tag`` or ``{tag}``, whichever occurs more often (``{tag}`` on a tie), six tags, spellings of "none" count for violators
and violates only. A section ends where the next known tag begins; the first of two sections of one name counts.

A section is a struct (state, text) with the states ``present``, ``none`` and ``absent``. A null comment has no sections.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgeloom.functions.text import lines, strip

ENTRIES = "array<struct<name:string,reason:string>>"
INDEX_TAGS = ("pre", "post", "violators", "violates", "inv", "tests", "quint", "quint-module")
LSP_TAGS = ("pre", "post", "violators", "violates", "tests", "quint")
_DASH = "—"
_NONE_SPELLINGS = ("(none)", "none", "None", "(None)")


def _brace(tags: tuple[str, ...]) -> str:
    return r"\{(" + "|".join(tags) + r")\}"


def _at(tags: tuple[str, ...]) -> str:
    # A tag is the whole run after "@" up to a blank, tab or line break; an "@" inside a run begins none.
    return r"@(?<!@[^ \n\t]{0,64}@)(" + "|".join(tags) + r")(?=[ \n\t]|\z)"


def _section(text: Column, nones: tuple[str, ...]) -> Column:
    def of(t: Column) -> Column:
        state = F.when(t.isNull() | (t == ""), "absent")
        state = (state.when(t.isin(*nones), "none") if nones else state).otherwise("present")
        return F.struct(state.alias("state"), F.when(state == "present", t).alias("text"))

    return let(strip(text), of)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _parts(raw: Column, pattern: str) -> Column:
    """Struct (names, texts): tag names in order; texts before, between and after them."""
    return F.struct(F.regexp_extract_all(raw, F.lit(pattern), F.lit(1)).alias("names"), F.split(raw, pattern, -1).alias("texts"))


def _named(names: Column, texts: Column, tag: str) -> Column:
    at = F.array_position(names, tag)
    return F.when(at > 0, F.get(texts, at.cast("int")))


def _sections(parts: Column, tags: tuple[str, ...], nones: dict[str, tuple[str, ...]]) -> Column:
    cols = [_section(F.get(parts["texts"], F.lit(0)), nones.get("summary", ())).alias("summary")]
    cols += [_section(_named(parts["names"], parts["texts"], t), nones.get(t, ())).alias(t.replace("-", "_")) for t in tags]
    return F.struct(*cols)


def parse_index(raw: Column) -> Column:
    """Struct of the sections of the ``index`` dialect: summary and the eight tags (``quint-module`` as quint_module)."""
    nones = dict.fromkeys(("summary", *INDEX_TAGS), ("(none)",))
    return let(_parts(F.coalesce(raw, F.lit("")), _brace(INDEX_TAGS)), lambda p: _sections(p, INDEX_TAGS, nones))


def index_warnings(raw: Column) -> Column:
    """What the ``index`` dialect warns of: unknown tags in order, then sections that come again."""
    def duplicates(known: Column) -> Column:
        return F.filter(known, lambda x, i: F.array_position(known, x) <= i)

    def of(tags: Column) -> Column:
        unknown = F.filter(tags, lambda x: ~x.isin(*INDEX_TAGS))
        again = let(F.filter(tags, lambda x: x.isin(*INDEX_TAGS)), duplicates)
        return F.concat(
            F.transform(unknown, lambda x: F.concat(F.lit("Unknown tag: {"), x, F.lit("}"))),
            F.transform(again, lambda x: F.concat(F.lit("Duplicate section: {"), x, F.lit(f"}} {_DASH} using first occurrence"))),
        )

    return let(F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r"\{([^{}\n]+)\}"), F.lit(1)), of)


def parse_lsp(raw: Column) -> Column:
    """Struct of the sections of the ``lsp`` dialect: summary and the six tags."""
    raw = F.coalesce(raw, F.lit(""))
    nones = dict.fromkeys(("violators", "violates"), _NONE_SPELLINGS)
    both = F.struct(_parts(raw, _brace(LSP_TAGS)).alias("b"), _parts(raw, _at(LSP_TAGS)).alias("a"))
    picked = let(both, lambda x: F.when(F.size(x["b"]["names"]) >= F.size(x["a"]["names"]), x["b"]).otherwise(x["a"]))
    return let(picked, lambda p: _sections(p, LSP_TAGS, nones))


def _points(section: Column, present: int, none: int = 0) -> Column:
    return F.when(section["state"] == "present", present).when(section["state"] == "none", none).otherwise(0)


def score_index(sections: Column) -> Column:
    """0..100: summary 15, pre 15, post 20 ("none" counts), violators and violates 25 each, 12 for "none"."""
    def total(s: Column) -> Column:
        return _points(s["summary"], 15, 15) + _points(s["pre"], 15, 15) + _points(s["post"], 20, 20) + _points(s["violators"], 25, 12) + _points(s["violates"], 25, 12)

    return let(sections, total)


def score_lsp(sections: Column) -> Column:
    """0..100, null if nothing is there: summary 15, pre 15, post 20, violators and violates 20 (12), tests 5, quint 5."""
    return let(sections, _score_lsp)


def _score_lsp(s: Column) -> Column:
    parts = ("summary", "pre", "post", "violators", "violates", "tests", "quint")
    total = (
        _points(s["summary"], 15) + _points(s["pre"], 15) + _points(s["post"], 20) + _points(s["violators"], 20, 12) + _points(s["violates"], 20, 12)
        + _points(s["tests"], 5) + _points(s["quint"], 5)
    )
    nothing = F.lit(True)
    for p in parts:
        nothing = nothing & (s[p]["state"] == "absent")
    return F.when(~nothing, total)


def gated_score(score: Column, name: Column, intent: Column) -> Column:
    """Lambdas and undocumented functions have no score."""
    return F.when(intent.isNotNull() & ~name.contains(".<fun:"), score)


def _kept_lines(text: Column) -> Column:
    return F.filter(F.transform(lines(F.coalesce(text, F.lit(""))), strip), lambda x: (x != "") & (x != "(none)"))


def violators_json(text: Column) -> Column:
    """``[{"name":..,"reason":..},...]`` of lines split at the em dash, else at the first hyphen; null if there is none."""
    def entry(x: Column) -> Column:
        dash = F.instr(x, _DASH) > 1
        name = F.when(dash, strip(F.substring_index(x, _DASH, 1))).otherwise(strip(F.substring_index(x, "-", 1)))
        at = F.when(dash, F.instr(x, _DASH)).when(F.instr(x, "-") > 0, F.instr(x, "-")).otherwise(F.char_length(x))
        return F.struct(name.alias("name"), strip(F.substr(x, at + 1)).alias("reason"))

    def found(t: Column) -> Column:
        kept = F.filter(F.transform(_kept_lines(t), entry), lambda e: e["name"] != "")
        return let(kept, lambda k: F.when(~strip(t).isin(*_NONE_SPELLINGS) & (F.size(k) > 0), F.to_json(k)))

    return let(text, found)


def violator_entries(text: Column) -> Column:
    """(name, reason) of lines split at the em dash; other lines go on with the reason before; names in parentheses go."""
    def step(acc: Column, x: Column) -> Column:
        at = F.instr(x, _DASH)
        name = strip(F.substr(x, F.lit(1), at - 1))
        new = F.struct(name.alias("name"), strip(F.substr(x, at + 1)).alias("reason"))
        last = F.element_at(acc, -1)
        longer = F.struct(last["name"].alias("name"), F.concat_ws(" ", last["reason"], x).alias("reason"))
        grown = F.when(F.size(acc) > 0, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(acc)
        return F.when(at == 0, grown).when((name == "") | name.startswith("("), acc).otherwise(F.concat(acc, F.array(new)))

    return F.aggregate(_kept_lines(text), F.array().cast(ENTRIES), step)


def test_entries(text: Column) -> Column:
    """(file, case_name) of lines ``file: "case"``; the last quote closes; other lines are skipped."""
    def entry(x: Column) -> Column:
        rest = strip(F.substr(x, F.instr(x, ":") + 1))
        return F.struct(strip(F.substring_index(x, ":", 1)).alias("file"), F.regexp_extract(rest, r'^"(.+)"', 1).alias("case_name"))

    with_colon = F.filter(_kept_lines(text), lambda x: F.instr(x, ":") > 0)
    return F.filter(F.transform(with_colon, entry), lambda e: (e["file"] != "") & (e["case_name"] != ""))
