"""Several values packed in one field (problem 3).

Method. A first pass scans every text once and notes which characters stand between its pieces, outside quotes and
brackets. Per source (table, field and producing hand) these notes are pre-aggregated to counts per set of separators, and
candidates are scored greedily. The consistency of a candidate is the share of the texts it occurs in whose piece count is
fully explained by it and the separators accepted before, divided by one plus the spread (deviation over mean) of these
piece counts; its regularity is the share of pieces of these texts that are whole values of the field's type. The best
candidate is accepted if the product holds; then the others are scored again. The second pass splits every text by its
source's accepted separators into its pieces with their positions.

Both passes work on the code points of a whole Arrow batch at a time. Only texts with quotes, with brackets that do not
match or with a bracketed variant are read one by one.

Two value types are known. ``word``: letters, digits and ``_ - . :``, or anything in double or single quotes. ``type``: one
type expression, whose brackets of any kind may hold anything, with one ``label:`` at most; only double quotes quote it.
Which punctuation belongs to values is a parameter (``Grammar.own``).

Defined cases: null, empty and blank texts, ``[]`` and texts of separators only give no row; an empty piece takes no
position; a doubled quote inside quotes is one quote; brackets around a whole field are dropped unless they are themselves
a type (a variant between backticks); a quote or bracket without its partner belongs to the piece it stands in; a letter,
digit or mark of any script is never a separator; a character that is never accepted as a separator stays in its piece;
repeated rows count once; columns beyond the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.cluster import broadcast_if_small

#: Scores of the accepted separators of the test tables are 0.39 at the least on the smallest (sources of a few texts) and
#: 0.58 at the least on the largest.
MIN_SCORE = 0.3
MIN_REGULARITY = 0.9

_BRACKET = r"(?<b>\((?:[^()\[\]{}]|(?&b))*+\)|\[(?:[^()\[\]{}]|(?&b))*+\]|\{(?:[^()\[\]{}]|(?&b))*+\})"
_DOUBLE = r'"(?:[^"]|"")*+"'
_SINGLE = r"'(?:[^']|'')*+'"
_LETTER = r"\p{L}\p{N}\p{M}"


@dataclass(frozen=True)
class Grammar:
    """What values look like: the quotes, whether brackets hold together, the punctuation of unquoted values, and their letters."""

    quotes: str
    brackets: bool
    own: str
    letters: str = _LETTER

    @property
    def paired(self) -> frozenset[str]:
        """Never separators: without their partner they belong to a piece and make it irregular."""
        return frozenset(self.quotes + ("()[]{}" if self.brackets else ""))

    @property
    def held(self) -> str:
        """Pattern of what quotes hold together."""
        return "|".join({'"': _DOUBLE, "'": _SINGLE}[q] for q in self.quotes)


GRAMMARS = {"word": Grammar("\"'", False, "_-.:", "A-Za-z0-9"), "type": Grammar('"', True, "_.':")}


@lru_cache(maxsize=100)
def _patterns(g: Grammar) -> tuple[regex.Pattern, regex.Pattern]:
    """(atom, value): what holds together at depth 0 of a text, and a whole value."""
    own, bare = ("".join("\\" + c for c in g.own if c not in left_out) for left_out in ("", ":"))
    if not g.brackets:
        return regex.compile(rf"{g.held}|[{_LETTER}{own}]+"), regex.compile(rf"{g.held}|[{g.letters}{own}]+")
    word = rf"[{g.letters}{bare}]+"
    atom = rf"{g.held}|{_BRACKET}|[{_LETTER}{own}]+(?: (?=[{_LETTER}{bare}(\[{{]))?+"
    return regex.compile(atom), regex.compile(rf"{g.held}|(?:{word} ?: ?)?(?:{_BRACKET}|{word})(?: ?(?:(?&b)|{word}))*")


@dataclass(frozen=True)
class Packed:
    """A packed text column: its table, key, the column that names the writing hand (or None) and the value type or grammar."""

    src_table: str
    frame: DataFrame
    row_id: str
    field: str
    source: str | None
    style: str | Grammar


def _grammar(style: str | Grammar) -> Grammar:
    return GRAMMARS[style] if isinstance(style, str) else style


# ---- one text --------------------------------------------------------------------------------------------------------

def inner(text: str, style: str | Grammar) -> str:
    """The text without the square brackets around all of it."""
    text = text.strip()
    if len(text) < 2 or text[0] != "[" or text[-1] != "]":
        return text
    if _grammar(style).brackets:
        whole = regex.fullmatch(_BRACKET, text)
        if not whole or "`" in regex.sub(_BRACKET, "", text[1:-1]):
            return text
    return text[1:-1].strip()


def core(run: str, style: str | Grammar) -> str:
    """The separators a run between pieces stands for: its visible characters, else one white-space character."""
    g = _grammar(style)
    seen = "".join(sorted(set("".join(run.split())) - g.paired))
    if seen or not g.paired.isdisjoint(run):
        return seen
    return "\n" if "\n" in run or "\r" in run else "\t" if "\t" in run else "  " if g.brackets else " "


@lru_cache(maxsize=200_000)
def layout(text: str, style: str | Grammar) -> tuple[str, int, int]:
    """(separators joined by U+001F, pieces, regular pieces) of one text."""
    g = _grammar(style)
    atom, value = _patterns(g)
    text = inner(text, g)
    cores, pieces, regular, end, piece = set(), 0, 0, 0, ""

    def close() -> None:
        nonlocal pieces, regular, piece
        if piece.strip():
            pieces += 1
            regular += bool(value.fullmatch(piece.strip()))
        piece = ""

    for m in atom.finditer(text):
        gap = text[end : m.start()]
        if gap and not (g.brackets and gap == " " and piece):
            close()
            if gap.strip() or end:
                cores.add(core(gap, g))
            gap = ""
        piece += gap + m.group()
        end = m.end()
    close()
    if text[end:].strip():
        cores.add(core(text[end:], g))
    pieces += not g.paired.isdisjoint(atom.sub("", text))
    return "\x1f".join(sorted(set("".join(c for c in cores if c.strip())) | {c for c in cores if c and not c.strip()})), pieces, regular


# ---- a batch of texts ------------------------------------------------------------------------------------------------

_NEWLINE, _TAB, _SPACE, _SPACES = 20, 18, 64, 65  # twice the code point; two spaces stand between one and the next character


class _Scan:
    """The code points of many texts, what belongs to values, and how deep in brackets each stands.

    ``hard`` marks the texts that are to be read one by one; the others are stripped of white space and outer brackets.
    """

    def __init__(self, texts: pa.Array, g: Grammar) -> None:
        texts = texts.cast(pa.string())
        off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        raw = texts.buffers()[2].to_pybytes()[off[0] : off[-1]] if len(texts) and texts.buffers()[2] else b""
        self.cp = cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        width = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        self.raw, self.g, self.n = np.frombuffer(raw, np.uint8), g, len(texts)
        self.at = np.concatenate([[0], np.cumsum(width)])
        self.row = np.repeat(np.arange(self.n), width)
        known = np.flatnonzero(np.bincount(cp)) if len(cp) else np.zeros(0, np.int64)
        chars, marked = [chr(c) for c in known], np.zeros(int(known[-1]) + 1 if len(known) else 1, bool)

        def of(test: Callable[[str], object]) -> np.ndarray:
            marked[known] = [bool(test(c)) for c in chars]
            return marked[cp]

        letter = regex.compile(f"[{_LETTER}]")
        self.blank, self.word = of(str.isspace), of(lambda c: c in g.own or letter.match(c))
        plain = regex.compile(f"[{g.letters}]")
        self.odd = self.word & of(lambda c: c not in g.own and not plain.match(c))
        self.hard = self._any(of(lambda c: c in g.quotes))
        self.depth = np.zeros(len(cp), np.int64)
        first, last = self._ends(~self.blank)
        boxed = (last - first > 0) & self._is(first, "[") & self._is(last, "]")
        if g.brackets:
            opens, closes = of(lambda c: c in "([{"), of(lambda c: c in ")]}")
            level = np.cumsum(opens.astype(np.int64) - closes)
            before = np.concatenate([[0], level])[self.at[:-1]]
            level = level - np.repeat(before, width)
            self.hard |= self._any(level < 0) | (self._last(level) != 0) | self._mismatched(opens, closes, level)
            self.depth = level + closes  # a bracket stands at the depth inside it
            # The first bracket closes only at the end: then it is around the whole field, unless it is a variant.
            self.hard |= boxed & self._any(of(lambda c: c == "`"))
            inside = np.arange(len(cp)) < np.repeat(last, width)
            boxed &= ~self._any((level == 0) & inside & (np.arange(len(cp)) >= np.repeat(first, width)))
            self.depth = self.depth - np.repeat(boxed, width)
        live = (np.arange(len(cp)) >= np.repeat(first + boxed, width)) & (np.arange(len(cp)) <= np.repeat(last - boxed, width))
        live &= np.repeat(~self.hard, width)
        first, last = self._ends(live & ~self.blank)
        self.live = live & (np.arange(len(cp)) >= np.repeat(first, width)) & (np.arange(len(cp)) <= np.repeat(last, width))

    def _is(self, at: np.ndarray, char: str) -> np.ndarray:
        return self.cp[np.clip(at, 0, max(len(self.cp) - 1, 0))] == ord(char) if len(self.cp) else np.zeros(self.n, bool)

    def _any(self, mask: np.ndarray) -> np.ndarray:
        return np.bincount(self.row[mask], minlength=self.n) > 0

    def _last(self, values: np.ndarray) -> np.ndarray:
        full = self.at[1:] > self.at[:-1]
        out = np.zeros(self.n, np.int64)
        out[full] = values[self.at[1:][full] - 1]
        return out

    def _ends(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last marked position of each text; of a text without any, positions that hold nothing."""
        where = np.flatnonzero(mask)
        first, last = self.at[1:].copy(), self.at[1:] - 1
        rows = self.row[where]
        last[rows] = where
        first[rows[::-1]] = where[::-1]
        return first, last

    def _mismatched(self, opens: np.ndarray, closes: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Texts in which a bracket is closed by one of another kind."""
        where = np.flatnonzero(opens | closes)
        depth = np.where(opens[where], level[where], level[where] + 1)
        where = where[np.lexsort((where, depth, self.row[where]))]
        a, b = where[:-1], where[1:]
        step = self.cp[b].astype(np.int64) - self.cp[a]
        bad = opens[a] & ((self.row[a] != self.row[b]) | ~closes[b] | (step < 1) | (step > 2))
        return np.bincount(self.row[a[bad]], minlength=self.n) > 0

    # -- first pass

    def layouts(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Of each text: its separators joined by U+001F in order, the number of pieces and of regular ones."""
        held = self.live & (self.word | (self.depth > 0))
        gap = self.live & ~held
        if self.g.brackets:  # one space between two held characters stays in the piece
            one = gap & (self.cp == 32)
            one[1:] &= held[:-1]
            one[:-1] &= held[1:]
            one[:1] = one[-1:] = False
            joined, gap = held | one, gap & ~one
        else:
            one, joined = np.zeros(len(held), bool), held
        start = joined & ~np.concatenate([[False], (joined[:-1]) & (self.row[1:] == self.row[:-1])]) if len(held) else joined
        piece = np.cumsum(start) - 1
        first = np.flatnonzero(start)
        good = np.ones(len(first), bool)
        good[piece[joined & self.odd & (self.depth == 0)]] = False
        if self.g.brackets:
            good &= self._labelled(piece, first, joined, one)
        pieces = np.bincount(self.row[first], minlength=self.n)
        regular = np.bincount(self.row[first[good]], minlength=self.n)
        return self._separators(gap), pieces, regular

    def _labelled(self, piece: np.ndarray, first: np.ndarray, joined: np.ndarray, one: np.ndarray) -> np.ndarray:
        """Pieces without a colon outside brackets, or with one behind their first word and before something else."""
        n, flat = len(first), joined & (self.depth == 0)
        colon = np.flatnonzero(flat & (self.cp == ord(":")))
        many = np.bincount(piece[colon], minlength=n)
        at = np.full(n, -1, np.int64)
        at[piece[colon]] = colon
        last = np.full(n, -1, np.int64)
        every = np.flatnonzero(joined)
        last[piece[every]] = every
        early = joined & (np.arange(len(joined)) < at[np.maximum(piece, 0)]) if n else joined
        spaces = np.bincount(piece[np.flatnonzero(early & one)], minlength=n)
        deep = np.bincount(piece[np.flatnonzero(early & (self.depth > 0))], minlength=n)
        spaced = one[np.maximum(at - 1, 0)] if len(one) else np.zeros(n, bool)
        fits = (many == 1) & (at > first) & (at < last) & (deep == 0) & ((spaces == 0) | ((spaces == 1) & spaced))
        return (many == 0) | fits

    def _separators(self, gap: np.ndarray) -> pa.Array:
        run = gap & ~np.concatenate([[False], gap[:-1] & (self.row[1:] == self.row[:-1])]) if len(gap) else gap
        ident = np.cumsum(run) - 1
        n, where = int(run.sum()), np.flatnonzero(gap)
        seen = np.zeros(n, bool)
        visible = where[~self.blank[where]]
        seen[ident[visible]] = True
        paired = np.array([ord(c) for c in self.g.paired], np.uint32)
        kind = np.full(n, _SPACES if self.g.brackets else _SPACE, np.int64)
        kind[ident[where[self.cp[where] == 9]]] = _TAB
        kind[ident[where[np.isin(self.cp[where], (10, 13))]]] = _NEWLINE
        visible = visible[~np.isin(self.cp[visible], paired)]
        rows = np.concatenate([self.row[visible], self.row[run][~seen]])
        codes = np.concatenate([self.cp[visible].astype(np.int64) * 2, kind[~seen]])
        pairs = np.unique(np.stack([rows, codes]), axis=1) if len(rows) else np.zeros((2, 0), np.int64)
        distinct, which = np.unique(pairs[1], return_inverse=True)
        names = pa.array([" " * 2 if c == _SPACES else chr(c // 2) for c in distinct], pa.string())
        upto = np.searchsorted(pairs[0], np.arange(self.n + 1)).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(upto), names.take(pa.array(which, pa.int64()))), "\x1f")

    # -- second pass

    def pieces(self, of: np.ndarray, rules: Sequence[tuple[str, ...]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(row, position, value) of every value; text i is split by the separators ``rules[of[i]]``."""
        sep = np.zeros(len(self.cp), bool)
        flat = self.live & (self.depth == 0)
        run = self.blank & ~np.concatenate([[False], self.blank[:-1] & (self.row[1:] == self.row[:-1])]) if len(sep) else self.blank
        ident = np.cumsum(run) - 1
        n = int(run.sum())
        length = np.bincount(ident[self.blank], minlength=n)
        lines = np.bincount(ident[self.blank & np.isin(self.cp, (10, 13))], minlength=n) > 0
        tabs = np.bincount(ident[self.blank & (self.cp == 9)], minlength=n) > 0
        rule_of = of[self.row] if len(sep) else np.zeros(0, np.int64)
        for i, separators in enumerate(rules):
            mine = flat & (rule_of == i)
            visible = np.array([ord(c) for c in separators if c.strip()], np.uint32)
            sep |= mine & np.isin(self.cp, visible)
            cuts = np.zeros(n, bool)
            for blank, when in ((" ", length > 0), ("\n", lines), ("\t", tabs), ("  ", length > 1)):
                if blank in separators:
                    cuts |= when
            if n and cuts.any():
                sep |= mine & self.blank & cuts[np.maximum(ident, 0)]
        solid = np.flatnonzero(self.live & ~sep & ~self.blank)
        group = np.cumsum(sep)[solid] if len(solid) else solid
        row = self.row[solid]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (row[1:] != row[:-1])]) if len(solid) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        first, last = solid[begin], solid[np.concatenate([begin[1:], [len(solid)]]) - 1] if len(begin) else solid[:0]
        row = row[begin]
        pos = np.arange(len(row)) - np.searchsorted(row, row)
        return row, pos, self._texts(first, last + 1)

    def _texts(self, begin: np.ndarray, end: np.ndarray) -> pa.Array:
        """The stretches of the texts as strings."""
        width = 1 + (self.cp >= 0x80).astype(np.int64) + (self.cp >= 0x800) + (self.cp >= 0x10000)
        at = np.concatenate([[0], np.cumsum(width)])
        begin, size = at[begin], at[end] - at[begin]
        upto = np.concatenate([[0], np.cumsum(size)])
        taken = self.raw[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
        return pa.StringArray.from_buffers(len(size), pa.py_buffer(upto.astype(np.int32).tobytes()), pa.py_buffer(taken.tobytes()))


def _by_style(b: pa.RecordBatch, grammars: Sequence[Grammar]) -> Iterator[tuple[pa.RecordBatch, Grammar]]:
    for i, g in enumerate(grammars):
        part = b.filter(pc.equal(b.column("style"), i))
        if part.num_rows:
            yield part, g


def _layouts(grammars: Sequence[Grammar]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, g in _by_style(b, grammars):
                texts = part.column("text")
                scan = _Scan(texts, g)
                seps, pieces, regular = scan.layouts()
                hard = np.flatnonzero(scan.hard)
                got = [layout(t, g) for t in texts.take(pa.array(hard)).to_pylist()]
                pieces[hard], regular[hard] = [x[1] for x in got], [x[2] for x in got]
                seps = pc.replace_with_mask(seps, pa.array(scan.hard), pa.array([x[0] for x in got], pa.string()))
                t = pa.table({"source": part.column("source"), "seps": seps, "texts": np.ones(len(pieces), np.int64), "pieces": pieces, "squares": pieces * pieces, "regular": regular})
                sums = t.group_by(["source", "seps"]).aggregate([(c, "sum") for c in ("texts", "pieces", "squares", "regular")])
                yield from sums.rename_columns([c.removesuffix("_sum") for c in sums.column_names]).select(t.column_names).to_batches()

    return run


def _accept(stats: pd.DataFrame) -> pd.DataFrame:
    """Greedy scoring for one source; a row per accepted separator."""
    sets = [frozenset(s.split("\x1f")) - {""} for s in stats["seps"]]
    texts, pieces, squares, regular = (stats[c].to_numpy(float) for c in ("texts", "pieces", "squares", "regular"))
    taken, refused, rows = set(), set(), []
    while True:
        # Candidates: what the least unexplained texts still lack, one separator as a rule, several where they only occur together.
        lacks = {s - taken for s in sets} - refused - {frozenset()}
        if not lacks:
            break
        least = min(map(len, lacks))
        scored = []
        for lack in sorted((x for x in lacks if len(x) == least), key=sorted):
            with_it = [i for i, s in enumerate(sets) if s & lack]
            done = [i for i in with_it if sets[i] <= taken | lack]
            n = pieces[done].sum()
            reg = regular[done].sum() / n if n else 1.0
            mean = n / texts[done].sum() if n else 1.0
            spread = np.sqrt(max(squares[done].sum() / texts[done].sum() - mean**2, 0.0)) / mean if n else 0.0
            consistency = texts[done].sum() / texts[with_it].sum() / (1 + spread)
            scored.append((consistency * reg, reg, sorted(lack)))
        score, reg, best = max(scored)
        if score < MIN_SCORE or reg < MIN_REGULARITY:
            refused.add(frozenset(best))
            continue
        rows += [(c, len(taken), score) for c in best]
        taken |= set(best)
    found = [(str(stats["source"].iloc[0]), *r) for r in rows]
    return pd.DataFrame(found, columns=["source", "separator", "step", "score"], dtype=object)


@lru_cache(maxsize=10_000)
def _splitter(g: Grammar, separators: tuple[str, ...]) -> regex.Pattern:
    visible = regex.escape("".join(s for s in separators if s.strip()), literal_spaces=True)
    blank = [{"\n": r"\s*[\r\n]\s*", "\t": r"\s*\t\s*", " ": r"\s+", "  ": r"\s{2,}"}[s] for s in separators if not s.strip()]
    sep = "|".join(([rf"[{visible.replace('-', chr(92) + '-')}]"] if visible else []) + blank) or r"(?!)"
    held = g.held + (f"|{_BRACKET}" if g.brackets else "")
    # Runs in which nothing can begin are taken at once, everything else character by character.
    plain = rf"[^\s{regex.escape(''.join(sorted(g.paired)))}{visible.replace('-', chr(92) + '-')}]++"
    return regex.compile(rf"(?P<held>{held})|(?P<sep>{sep})|(?P<rest>{plain}|.)", regex.DOTALL)


@lru_cache(maxsize=200_000)
def split(text: str, style: str | Grammar, separators: tuple[str, ...]) -> tuple[str, ...]:
    """The values of one text."""
    g = _grammar(style)
    pieces, piece = [], []
    for m in _splitter(g, separators).finditer(inner(text, g)):
        if m.lastgroup == "sep" or m.group("sep") is not None:
            pieces.append("".join(piece))
            piece = []
        else:
            piece.append(m.group())
    pieces.append("".join(piece))
    out = []
    for p in pieces:
        p = p.strip()
        if len(p) > 1 and p[0] in g.quotes and p[0] == p[-1] and regex.fullmatch(_DOUBLE if p[0] == '"' else _SINGLE, p):
            p = p[1:-1].replace(p[0] * 2, p[0]).strip()
        if p:
            out.append(p)
    return tuple(out)


def _split(grammars: Sequence[Grammar]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, g in _by_style(b, grammars):
                texts, coded = part.column("text"), pc.fill_null(part.column("separators"), "").dictionary_encode()
                rules = [tuple(x.split("\x1f")) if x else () for x in coded.dictionary.to_pylist()]
                of = coded.indices.to_numpy().astype(np.int64)
                scan = _Scan(texts, g)
                row, pos, item = scan.pieces(of, rules)
                hard = np.flatnonzero(scan.hard)
                got = [split(t, g, rules[of[i]]) for i, t in zip(hard, texts.take(pa.array(hard)).to_pylist())]
                sizes = np.array([len(x) for x in got], np.int64)
                row = np.concatenate([row, np.repeat(hard, sizes)])
                pos = np.concatenate([pos, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)])
                item = pa.concat_arrays([item, pa.array([v for x in got for v in x], pa.string())])
                own = [part.column(c).take(pa.array(row)) for c in ("src_table", "row_id", "field")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(pos, pa.int64()), item], names=["src_table", "row_id", "field", "pos", "item"])

    return run


def _packed(columns: Sequence[Packed]) -> tuple[DataFrame, list[Grammar]]:
    """The texts with their source and the number of their grammar, and the grammars."""
    grammars = list(dict.fromkeys(_grammar(p.style) for p in columns))
    parts = [
        p.frame.where(F.col(p.field).isNotNull()).select(
            F.lit(p.src_table).alias("src_table"), F.col(p.row_id).cast("bigint").alias("row_id"), F.lit(p.field).alias("field"),
            F.concat_ws("/", F.lit(p.src_table), F.lit(p.field), F.col(p.source) if p.source else F.lit("")).alias("source"),
            F.lit(grammars.index(_grammar(p.style))).alias("style"), F.col(p.field).alias("text"),
        )
        for p in columns
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, grammars


def separators(columns: Sequence[Packed]) -> DataFrame:
    """(source, separator, step, score): the separators accepted for each source, in order of acceptance.

    What is scored has one row per source and set of separators, whatever the number of texts.
    """
    texts, grammars = _packed(columns)
    sums = ("texts", "pieces", "squares", "regular")
    stats = (
        texts.select("source", "style", "text")
        .mapInArrow(_layouts(grammars), "source string, seps string, " + ", ".join(f"{c} bigint" for c in sums))
        .groupBy("source", "seps").agg(*(F.sum(c).alias(c) for c in sums))
    )
    return stats.groupBy("source").applyInPandas(_accept, "source string, separator string, step int, score double")


def split_values(columns: Sequence[Packed]) -> DataFrame:
    """(src_table, row_id, field, pos, item)."""
    rules = separators(columns).groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("separator")), "\x1f").alias("separators"))
    texts, grammars = _packed(columns)
    rows = texts.dropDuplicates(["src_table", "row_id", "field", "text"])
    return rows.join(broadcast_if_small(rules), "source", "left").select("src_table", "row_id", "field", "style", "text", "separators").mapInArrow(
        _split(grammars), "src_table string, row_id bigint, field string, pos bigint, item string"
    )
