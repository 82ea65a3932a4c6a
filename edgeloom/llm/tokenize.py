"""Encoding of a corpus with a public tokenizer (problem 6).

Method: forced-boundary splitting. A pair of neighbouring bytes that stands in no vocabulary token can be in no token of
any encoding, so a text can be cut there. Cuts are found for a whole Arrow batch at once with a 65,536-entry table; the
fragments are encoded independently, each distinct one of a batch once, and their ids are gathered back in order.

The pattern that splits text before merging looks at its neighbourhood, so a cut is only used where the pattern cannot
notice it: at a character boundary; not after white space, except after one tab or line break between two characters that
are not white space; and before an apostrophe only if an ASCII letter or digit precedes (else the cut could make a
contraction). Everywhere else the text stays together, so the ids equal those of the whole text.

Vocabularies in rank form are encoded this way. The other public tokenizers rewrite text before they split it (lower
case, added marks), so no byte of theirs marks a certain cut; their texts are encoded whole by their library.

Defined cases: null and empty texts give an empty list; special tokens' strings are ordinary text; repeated ids are
repeated rows; other columns are ignored. Whole texts are encoded, whatever their length.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from edgeloom.llm.arrowtext import bytes_and_offsets, ranges, slices

TOKENIZERS = os.environ.get("EDGELOOM_TOKENIZERS", "/opt/tokenizers")
FILES = {
    "byte_bpe_50k": "byte_bpe_50k.tiktoken",
    "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken",
    "word_bpe_49k": "word_bpe_49k.json",
    "piece_bpe_32k": "piece_bpe_32k.model",
}
#: Fixed value: the pattern of the rank vocabularies, as their README gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded fragments kept between batches of a worker; the memory is emptied when it is full.
MEMO = 200_000
#: Last two UTF-8 bytes of the white space outside ASCII.
_WIDE_SPACE = [(0xC2, 0x85), (0xC2, 0xA0), (0x9A, 0x80), (0x80, 0xA8), (0x80, 0xA9), (0x80, 0xAF), (0x81, 0x9F)]
_WIDE_SPACE_RUN = [(0x80, x) for x in range(0x80, 0x8B)]
_ASCII_SPACE = [*range(0x09, 0x0E), *range(0x1C, 0x21)]


class RankEncoder:
    """Byte-level merges by rank, over certain fragments."""

    def __init__(self, raw: bytes) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        self._encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.inside = np.zeros(1 << 16, bool)
        for token in ranks:
            t = np.frombuffer(token, np.uint8).astype(np.int64)
            self.inside[(t[:-1] << 8) | t[1:]] = True
        self.space = np.zeros((256, 256), bool)  # by the last two bytes of the character before
        self.space[:, _ASCII_SPACE] = True
        for a, b in _WIDE_SPACE + _WIDE_SPACE_RUN:
            self.space[a, b] = True
        self.space = self.space.ravel()
        byte = np.arange(256)
        self.starts = (byte & 0xC0) != 0x80
        self.break_ = np.isin(byte, [0x09, 0x0A, 0x0D])
        self.solid = self.starts & ~np.isin(byte, [*_ASCII_SPACE, 0xC2, 0xE1, 0xE2, 0xE3])
        self.alnum = np.array([chr(b).isascii() and chr(b).isalnum() for b in byte])
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def cuts(self, b: np.ndarray) -> np.ndarray:
        """For each byte, whether a fragment certainly begins there; text edges are not looked at."""
        n = len(b)
        out = np.zeros(n, bool)
        if n < 2:
            return out
        pair = (b[:-1].astype(np.uint16) << 8) | b[1:]
        ok = ~self.inside[pair] & self.starts[b[1:]]
        after_space = np.empty(n - 1, bool)
        after_space[0] = True  # nothing is known before the first byte
        after_space[1:] = self.space[pair[:-1]]
        lone_break = np.zeros(n - 1, bool)
        lone_break[2:] = self.break_[b[2:-1]] & ~self.space[pair[:-2]] & self.solid[b[3:]]
        ok &= ~after_space | lone_break
        ok &= (b[1:] != 0x27) | self.alnum[b[:-1]]
        out[1:] = ok
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts."""
        b, off = bytes_and_offsets(texts)
        begins = self.cuts(b)
        begins[off[:-1][off[:-1] < len(b)]] = True
        # The first bytes of a text must not be judged by the text before it.
        for k in (1, 2, 3):
            at = off[:-1] + k
            at = at[(at < off[1:]) & (at < len(b))]
            begins[at] = False
        starts = np.flatnonzero(begins)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        edges = np.append(starts, len(b)).astype(np.int64)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(b)]).dictionary_encode()
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, encode, lists = self.memo, self._encode, []
        for f in parts.dictionary.to_pylist():
            ids = memo.get(f)
            if ids is None:
                ids = tuple(encode(f.decode()))
                if len(f) <= 64:
                    memo[f] = ids
            lists.append(ids)
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        pool = np.fromiter((i for ids in lists for i in ids), np.int32, int(size.sum()))
        code = parts.indices.to_numpy()
        lengths = size[code]
        ids = pool[ranges((np.cumsum(size) - size)[code], lengths)]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        return ids, upto[np.searchsorted(starts, off)]


class LibraryEncoder:
    """Whole texts, encoded by the vocabulary's own library."""

    def __init__(self, file: str, raw: bytes) -> None:
        if file.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_buffer(raw)
            t.encode_special_tokens = True
            self._batch = lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_proto=raw)
            self._batch = lambda texts: p.encode(texts, num_threads=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        got = self._batch([t or "" for t in texts.to_pylist()])
        off = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int64)
        return np.array([i for g in got for i in g], np.int32), off


_LOADED: dict[str, RankEncoder | LibraryEncoder] = {}


def encoder(name: str, raw: bytes) -> RankEncoder | LibraryEncoder:
    """One encoder per worker process."""
    if name not in _LOADED:
        file = FILES[name]
        _LOADED[name] = RankEncoder(raw) if file.endswith(".tiktoken") else LibraryEncoder(file, raw)
    return _LOADED[name]


def _per_batch(name: str, shared, id_col: str, text_col: str, make: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, shared.value)
        for batch in batches:
            for part in slices(batch, text_col):
                ids, off = enc.encode(part.column(text_col))
                yield make(part.column(id_col), ids, off)

    return run


def _shared(df: DataFrame, name: str, folder: str):
    """The vocabulary file (about 1 MB, a fixed size) goes to the executors once."""
    with open(os.path.join(folder, FILES[name]), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids array<int>) of every row."""
    def make(key: pa.Array, ids: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
        return pa.RecordBatch.from_arrays([key, lists], names=[id_col, "ids"])

    slim = df.select(df[id_col].cast("bigint").alias(id_col), df[text_col].alias(text_col))
    return slim.mapInArrow(_per_batch(tokenizer, _shared(df, tokenizer, folder), id_col, text_col, make), f"`{id_col}` bigint, ids array<int>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, n_tokens) of every row; ids never leave the workers."""
    def make(key: pa.Array, ids: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([key, pa.array(np.diff(off).astype(np.int64))], names=[id_col, "n_tokens"])

    slim = df.select(df[id_col].cast("bigint").alias(id_col), df[text_col].alias(text_col))
    return slim.mapInArrow(_per_batch(tokenizer, _shared(df, tokenizer, folder), id_col, text_col, make), f"`{id_col}` bigint, n_tokens bigint")
