"""Visually identical text with different characters (problem 8).

Method. The text column of an Arrow batch becomes one array of code points. Per code point a table holds what it stands
for: nothing (zero-width), a space (spaces of any width), its ordinary form (full and half width, letters and digits of
mathematical alphabets, Roman numerals and ligatures of Latin letters, shapes of one Arabic letter), its canonical
decomposition, with look-alike letters replaced. Which letters look alike is a parameter: the list below, or a file in the
format of the confusables table of the Unicode Consortium (UTS 39), which is not on every machine. One gather with expansion offsets writes all texts at once; then marks are
put in canonical order where they are not, and composed with their letters, the k-th mark of every letter in one step.
No Python string call is made per row.

What stays different: words, letter case, accents, punctuation, raised digits, line breaks and the number of spaces.

Defined cases: a null text has a null form; texts of ASCII characters only are their own form; texts whose form is empty
or white space never agree with anything; exact copies are no pair; a mark without a letter before it in its own text
stays as it is.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.types import StringType

from edgeloom.cluster import cut
from edgeloom.llm.arrowtext import bytes_and_offsets, ranges, strings

#: Letters of other scripts, and special ones of the Latin script, with the Latin letters they look like.
_ALIKE = (
    ("АВЕЅІЈКМНОРСТХԚԜҺӀ", "ABESIJKMHOPCTXQWHI"),  # Cyrillic
    ("асеорхуѕіјһԁԛԝѵӏ", "aceopxysijhdqwvl"),
    ("ҮԌԐᴦ", "YGEr"),
    ("ү", "y"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿϜ", "ABEZHIKMNOPTYXCJF"),  # Greek
    ("αγινορσυϲϳϱ", "ayivopoucjp"),
    ("ԼՕՍ", "LOU"),  # Armenian
    ("գզհյոսցօ", "qqhjnugo"),
    ("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᏀᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏴ", "DRTiAJEWMHGZbRWSVSLCPKB"),  # Cherokee
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),  # Lisu
    ("ⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬ", "BHIKMNOPCTYX"),  # Coptic
    ("ⲟⲣⲥ", "opc"),
    ("ıɑɡɩɪʏᴄᴏᴠᴡᴢꜱ", "iagiiycovwzs"),  # Latin
)
LOOKALIKES = {a: b for others, latins in _ALIKE for a, b in zip(others, latins, strict=True)}
#: Decompositions of the Unicode database whose two sides look the same.
_SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>")
_SHAPES = ("<initial>", "<medial>", "<final>", "<isolated>")
#: Format characters that are seen, and so are kept.
_SEEN_FORMAT = [*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD]
_TOP = 0x110000
#: Bytes of text whose code points are in memory at once; an index of 8 bytes stands beside each of them.
SLICE_BYTES = 1 << 20
#: Members of one group of agreeing texts that are paired in one task; larger groups are spread.
GROUP = 4096
#: Parts into which the texts of one form are spread where they meet what is known of the form.
SALTS = 16


class Table:
    """Lookup tables by code point, made once per worker from the Unicode database of the runtime and the look-alike letters."""

    def __init__(self, alike: Mapping[str, str] = LOOKALIKES) -> None:
        self.length = np.ones(_TOP, np.int64)
        self.start = np.arange(_TOP)
        pool, pairs = [], []
        marks: dict[int, int] = {}
        for cp in (*range(0x80, 0x2FA20), *range(0xE0000, 0xE0200)):
            ch = chr(cp)
            if m := unicodedata.combining(ch):
                marks[cp] = m
            how = unicodedata.decomposition(ch)
            kind = unicodedata.category(ch)
            if kind == "Cf" and cp not in _SEEN_FORMAT:
                to = ""
            elif kind == "Zs":
                to = " "
            elif _looks_like_parts(how, kind):
                to = unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in how.split()[1:]))
            elif how and how[0] != "<":  # syllables of Hangul have none here and stay composed
                to = unicodedata.normalize("NFD", ch)
                parts = [int(x, 16) for x in how.split()]
                if len(parts) == 2 and unicodedata.normalize("NFC", "".join(map(chr, parts))) == ch:
                    pairs.append((parts[0], parts[1], cp))
            else:
                to = ch
            to = "".join(alike.get(x, x) for x in to)
            if to != ch:
                self.length[cp], self.start[cp] = len(to), _TOP + len(pool)
                pool += map(ord, to)
        self.pool = np.concatenate([np.arange(_TOP), np.array(pool, np.int64)]).astype(np.uint32)
        self.mark = np.zeros(_TOP, np.uint8)
        self.mark[list(marks)] = list(marks.values())
        key = np.array([a * _TOP + b for a, b, _ in pairs], np.int64)
        order = np.argsort(key)
        self.pair, self.made = key[order], np.array([c for _, _, c in pairs], np.uint32)[order]
        second = {b for _, b, _ in pairs if not unicodedata.combining(chr(b))}
        self.second = np.zeros(_TOP, bool)  # composes with what is before it though it is no mark
        self.second[list(second)] = True
        self.second[0x1161:0x1176] = self.second[0x11A8:0x11C3] = True

    def compose(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The composed code point of each pair, 0 where there is none."""
        key = a.astype(np.int64) * _TOP + b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        out = np.where(self.pair[at] == key, self.made[at], 0).astype(np.uint32)
        a, b = a.astype(np.int64), b.astype(np.int64)
        lv = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
        lvt = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
        out = np.where(lv, 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28, out)
        return np.where(lvt, a + b - 0x11A7, out).astype(np.uint32)


def _looks_like_parts(how: str, kind: str) -> bool:
    """Whether a character looks like what the database takes it apart to: ligatures and Roman numerals if all letters are Latin."""
    tag, *parts = how.split() or [""]
    if tag == "<compat>":
        latin = all(chr(int(x, 16)).isascii() and chr(int(x, 16)).isalpha() for x in parts)
        return latin and (kind == "Nl" or kind in ("Ll", "Lu", "Lt") and len(parts) > 1)
    return tag in _SAME_LOOK or tag in _SHAPES and len(parts) == 1


def read_confusables(path: str) -> dict[str, str]:
    """Look-alike letters of a file of lines ``source ; target ; ...`` of hexadecimal code points, ``#`` begins a comment.

    Only letters are taken, and only those that do not decompose: accents, punctuation and digits stay what they are.
    """
    found = {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            fields = line.split("#", 1)[0].split(";")
            if len(fields) >= 2:
                a, b = ("".join(chr(int(x, 16)) for x in part.split()) for part in fields[:2])
                if len(a) == 1 and a.isalpha() and b.isalpha() and not a.isascii() and not unicodedata.decomposition(a):
                    found[a] = b
    return found


_TABLE: list[Table] = []


def table() -> Table:
    if not _TABLE:
        _TABLE.append(Table())
    return _TABLE[0]


def canonical_points(cp: np.ndarray, off: np.ndarray, t: Table | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Code points and text offsets of the consistent forms."""
    t = t or table()
    n = t.length[cp]
    upto = np.concatenate([[0], np.cumsum(n)])
    out, off = _join_letters(t.pool[ranges(t.start[cp], n)], upto[off])
    mark = t.mark[out]
    at = np.flatnonzero(mark)
    drop = np.zeros(len(out), bool)
    if len(at):
        first = np.zeros(len(out) + 1, bool)
        first[off] = True
        # Runs of marks: each belongs to the character before its first mark, unless the text begins there.
        opens = np.concatenate([[True], (np.diff(at) > 1) | first[at[1:]]])
        run = np.cumsum(opens) - 1
        if (~opens[1:] & (mark[at[1:]] < mark[at[:-1]])).any():
            order = np.lexsort((mark[at], run))
            out[at], mark[at] = out[at[order]], mark[at[order]]
        begin = at[opens]
        size = np.bincount(run)
        free = ~first[begin]
        begin, size = begin[free], size[free]
        base, last = begin - 1, np.zeros(len(begin), np.uint8)
        k = 0
        while len(begin):
            here = begin + k
            made = t.compose(out[base], out[here])
            joins = (made > 0) & ((last == 0) | (last < mark[here]))
            out[base[joins]] = made[joins]
            drop[here[joins]] = True
            last = np.where(joins, last, mark[here])
            k += 1
            more = size > k
            begin, base, size, last = begin[more], base[more], size[more], last[more]
    out, off = _without(out, off, drop)
    return _join_letters(out, off)


def _join_letters(out: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Composes neighbours that join though none is a mark; at most three in a row do."""
    t = table()  # letters that compose do not depend on the look-alike ones
    while True:
        at = np.flatnonzero(t.second[out])
        if not len(at):
            break
        first = np.zeros(len(out) + 1, bool)
        first[off] = True
        at = at[~first[at]]
        made = t.compose(out[at - 1], out[at])
        at, made = at[made > 0], made[made > 0]
        lone = np.concatenate([[True], np.diff(at) > 1])[: len(at)]
        at, made = at[lone], made[lone]
        if not len(at):
            break
        out[at - 1] = made
        drop = np.zeros(len(out), bool)
        drop[at] = True
        out, off = _without(out, off, drop)
    return out, off


def _without(out: np.ndarray, off: np.ndarray, drop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not drop.any():
        return out, off
    kept = np.concatenate([[0], np.cumsum(~drop)])
    return out[~drop], kept[off]


def _forms(texts: pa.Array, t: Table | None) -> pa.Array:
    b, off = bytes_and_offsets(texts)
    cp = np.frombuffer(b.tobytes().decode().encode("utf-32-le"), np.uint32)
    upto = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    out, at = canonical_points(cp, upto[off], t)
    width = np.where(out < 0x80, 1, np.where(out < 0x800, 2, np.where(out < 0x10000, 3, 4)))
    size = np.concatenate([[0], np.cumsum(width)])
    return strings(out.astype("<u4").tobytes().decode("utf-32-le").encode(), size[at])


def canonical(texts: pa.Array, t: Table | None = None) -> pa.Array:
    """The consistent form of every text of an Arrow array."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return texts
    b, off = bytes_and_offsets(texts)
    high = np.concatenate([[0], np.cumsum(b >= 0x80)])
    wide = np.flatnonzero(high[off[1:]] > high[off[:-1]])
    if not len(wide):
        return texts
    part = np.cumsum(np.diff(off)[wide]) // SLICE_BYTES
    groups = np.split(wide, np.flatnonzero(np.diff(part)) + 1)
    done = pa.concat_arrays([_forms(texts.take(pa.array(g)), t) for g in groups])
    where = np.arange(len(texts))
    where[wide] = len(texts) + np.arange(len(wide))
    return pa.concat_arrays([texts, done]).take(pa.array(where))


@arrow_udf(StringType())
def _canonical_form(texts: pa.Array) -> pa.Array:
    return canonical(texts).cast(pa.string())


def canonical_form(text: Column, alike: Mapping[str, str] | None = None) -> Column:
    """The consistent form of a text, by the given look-alike letters or the list of this module.

    Marked so that no filter on the form is pushed below it, which would compute the form twice.
    """
    if alike is None:
        return _canonical_form.asNondeterministic()(text)
    letters, made = dict(alike), []

    @arrow_udf(StringType())
    def form(texts: pa.Array) -> pa.Array:
        if not made:  # once per worker
            made.append(Table(letters))
        return canonical(texts, made[0]).cast(pa.string())

    return form.asNondeterministic()(text)


def canonical_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", alike: Mapping[str, str] | None = None) -> DataFrame:
    """(id, text): every text in its consistent form."""
    return df.select(df[id_col].alias(id_col), canonical_form(df[text_col], alike).alias("text"))


def _prints(df: DataFrame, id_col: str, text_col: str, alike: Mapping[str, str] | None) -> DataFrame:
    """(id, form, raw): 128-bit prints of the form and of the text itself, without blank texts; no text is shuffled."""
    def both(c: Column) -> Column:
        return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b"))

    slim = df.select(df[id_col].alias("id"), df[text_col].alias("raw"), canonical_form(df[text_col], alike).alias("form"))
    seen = slim.where(F.col("form").rlike(r"[^\s\x{85}\x{2028}\x{2029}]"))
    return cut(seen.select("id", both(F.col("form")).alias("form"), both(F.col("raw")).alias("raw")))


def _mixed(prints: DataFrame) -> DataFrame:
    """(form, members) of the forms that several different texts share."""
    g = prints.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"), F.count(F.lit(1)).alias("members"))
    return g.where(F.col("lo") != F.col("hi")).select("form", "members")


def _salted_join(prints: DataFrame, forms: DataFrame) -> DataFrame:
    """``prints`` with what ``forms`` say of their form. A form that many texts have is spread over salts by id."""
    salted = prints.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return salted.join(forms.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["form", "part"]).drop("part")


def agreeing_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", alike: Mapping[str, str] | None = None) -> DataFrame:
    """(a, b): pairs of ids, smaller first, whose texts differ and have the same form.

    Groups of exact copies alone never reach the join; a large group is spread over salts on one side.
    """
    prints = _prints(df, id_col, text_col, alike)
    members = _salted_join(prints, _mixed(prints)).withColumn("salts", F.ceil(F.col("members") / GROUP).cast("int"))
    a = members.select("form", F.col("id").alias("x"), F.col("raw").alias("rx"), F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    b = members.select("form", F.col("id").alias("y"), F.col("raw").alias("ry"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    pairs = a.join(b, ["form", "salt"]).where((F.col("x") < F.col("y")) & (F.col("rx") != F.col("ry")))
    return pairs.select(F.col("x").alias("a"), F.col("y").alias("b"))


def agreeing_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", alike: Mapping[str, str] | None = None) -> DataFrame:
    """(id, class_id, texts): for documents whose form several different texts share, the smallest id of the class."""
    prints = _prints(df, id_col, text_col, alike)
    # Distinct texts first, so that copies are combined on the map side and no set of a hot class is built.
    classes = prints.groupBy("form", "raw").agg(F.min("id").alias("least")).groupBy("form").agg(
        F.min("least").alias("class_id"), F.count(F.lit(1)).alias("texts")
    ).where(F.col("texts") > 1)
    return _salted_join(prints, classes).select(F.col("id").alias(id_col), "class_id", "texts")
