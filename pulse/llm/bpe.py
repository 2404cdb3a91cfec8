"""Byte-level BPE encoding and decoding, with tree concatenation of long texts.

Texts up to ``LEAF_CHARS`` are leaves of their own. A longer text is cut into leaves of ``LEAF_CHARS`` at any place, and
neighbours are joined pairwise up a tree. Up to ``SPREAD_CHARS`` the tree grows where the text is read; beyond, leaves are rows
that many tasks encode in parallel, so that no task encodes a very long text alone. Both grow the same tree. A node holds the exact encoding of its own text as a list of pieces (what
the split pattern yields) with their ids. Joining left and right:

* a window of the last and first pieces around the join is split again; it grows until its first
  piece agrees with the left side's (at a place that the pattern had settled without reading past the left text)
  and one of its later boundaries agrees with a boundary of the right side. The pattern reads from left to right
  and knows only where it stands, so beyond a common boundary both sides agree for good;
* a piece that runs over the join and is long (unsplit text) is not encoded again either: the ids of its two
  halves are kept, and a window of ids around the join is re-encoded, growing until its first id is the left
  side's and its last id the right side's. A sequence of ids is the encoding of its bytes if and only if every
  two neighbours are the encoding of theirs, so agreement at both ends makes the whole sequence exact.

Special tokens are ids of their own and are cut out first, as the tokenizer does. The rank table is read from
the tokenizer's JSON file (a parameter: a path, or the name of a public tokenizer's file, found where it is read); leaves are encoded with the tiktoken library's ``encode_ordinary``.

Cases: null is the empty text, which has no ids; identical rows are encoded once and returned as often as they
occur (spread texts) or where they stand (others); an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.llm.common import payload

LEAF_CHARS = 1 << 12
#: Characters beyond which the leaves of a text are spread over tasks.
SPREAD_CHARS = 1 << 16
#: Pieces of up to so many characters whose ids a codec remembers, and how many.
KNOWN_CHARS, KNOWN_PIECES = 32, 1 << 17
#: Fixed value: the split pattern of byte-level BPE tokenizers of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that the pattern may read beyond the end of a piece.
MARGIN = 3
#: Bytes from which a piece over a join is joined by ids instead of being encoded again.
LONG_PIECE = 256


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: itself if printable, else 256, 257, ..."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def located(tokenizer: str) -> str:
    """The file of a tokenizer on this machine; a bare name is that of a public one."""
    return tokenizer if os.path.dirname(tokenizer) else public_tokenizers.path(tokenizer)


Piece = tuple[int, list[int]]  # length in characters, ids


class Codec:
    """Encoding and decoding with one tokenizer file."""

    def __init__(self, path: str):
        with open(located(path), encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items()
                 if all(c in alphabet for c in token)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token in self.special:
            ranks.pop(token.encode(), None)
        self.engine = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        top = max([*ranks.values(), *self.special.values()]) + 1
        self.known: dict[str, list[int]] = {}
        self.bytes: list[bytes] = [b""] * top
        for token, i in ranks.items():
            self.bytes[i] = token
        for token, i in self.special.items():
            self.bytes[i] = token.encode()

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        if not any(s in text for s in self.special):
            return self.engine.encode_ordinary(text)
        ids: list[int] = []
        for part in self.cuts.split(text):
            ids.extend([self.special[part]] if part in self.special else self.engine.encode_ordinary(part))
        return ids

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of one piece; those of short pieces are remembered and must not be changed."""
        ids = self.known.get(piece)
        if ids is None:
            ids = self.engine._encode_single_piece(piece)
            if len(piece) <= KNOWN_CHARS:
                if len(self.known) >= KNOWN_PIECES:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def leaf(self, text: str) -> list[Piece]:
        return [(len(p), self.piece_ids(p)) for p in self.pattern.findall(text)]

    def grown(self, text: str, leaf_chars: int) -> list[int]:
        """Ids of a whole text by the tree over its leaves."""
        ids: list[int] = []
        for k, part in enumerate(self.cuts.split(text)):
            if k % 2:
                ids.append(self.special[part])
                continue
            tree = Tree(self)
            for at in range(0, len(part), leaf_chars):
                tree.add(self.leaf(part[at:at + leaf_chars]))
            ids.extend(tree.ids())
        return ids

    def _text(self, pieces: list[Piece]) -> str:
        return b"".join(self.bytes[i] for _, ids in pieces for i in ids).decode("utf-8")

    def join_ids(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of one piece from those of its two parts."""
        wide = 4
        while True:
            a, b = min(wide, len(left)), min(wide, len(right))
            window = b"".join(self.bytes[i] for i in (*left[len(left) - a:], *right[:b]))
            ids = self.engine._core_bpe.encode_single_piece(window)
            if (a == len(left) or ids[0] == left[len(left) - a]) and (b == len(right) or ids[-1] == right[b - 1]):
                return left[:len(left) - a] + ids + right[b:]
            wide *= 2

    def join(self, left: list[Piece], right: list[Piece]) -> list[Piece]:
        """The pieces of a text from those of its two halves."""
        if not left or not right:
            return left or right
        wide = 4
        while True:
            a, b = min(wide, len(left)), min(wide, len(right))
            near = left[len(left) - a:]
            chars_left, text = sum(n for n, _ in near), self._text([*near, *right[:b]])
            lengths = [len(p) for p in self.pattern.findall(text)]
            fits = a == len(left) or (lengths[0] == near[0][0] and chars_left - lengths[0] >= MARGIN)
            ends_right, at = {}, chars_left  # boundaries of the right side, and the pieces before them
            for k in range(b):
                at += right[k][0]
                ends_right[at] = k + 1
            used, at = None, 0
            for k, n in enumerate(lengths):
                at += n
                if at in ends_right and (b == len(right) and at == len(text) or at <= len(text) - MARGIN and k + 1 < len(lengths)):
                    used = (k + 1, ends_right[at])
                    break
            if fits and used:
                return [*left[:len(left) - a], *self._pieces(text, lengths[:used[0]], near, right[:used[1]], chars_left),
                        *right[used[1]:]]
            wide *= 2

    def _pieces(self, text: str, lengths: list[int], near: list[Piece], far: list[Piece], border: int) -> list[Piece]:
        """The window's pieces: known ones as they are, a long one over the border by its halves, others encoded."""
        known, at = {}, 0
        for n, ids in (*near, *far):
            known[at, at + n] = ids
            at += n
        out, at = [], 0
        for n in lengths:
            ids = known.get((at, at + n))
            if ids is None:
                halves = known.get((at, border)), known.get((border, at + n))
                if n >= LONG_PIECE and halves[0] and halves[1]:
                    ids = self.join_ids(*halves)
                else:
                    ids = self.piece_ids(text[at:at + n])
            out.append((n, ids))
            at += n
        return out


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


class Tree:
    """Joins a text's leaves in order, two nodes of one height at a time; at most one node a height is open."""

    def __init__(self, codec: Codec):
        self.codec, self.nodes = codec, []

    def add(self, leaf: list[Piece]) -> None:
        height = 0
        while self.nodes and self.nodes[-1][0] == height:
            leaf = self.codec.join(self.nodes.pop()[1], leaf)
            height += 1
        self.nodes.append((height, leaf))

    def ids(self) -> list[int]:
        whole: list[Piece] = []
        for _, node in reversed(self.nodes):
            whole = self.codec.join(node, whole)
        self.nodes = []
        return [i for _, ids in whole for i in ids]


def _lists(values: list) -> pa.Array:
    """Lists of ids as an Arrow array, by way of flat buffers."""
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate([np.asarray(v, np.int32) for v in values]) if values else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", leaf_chars: int = LEAF_CHARS,
           spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """``row`` (struct of the other columns) and ``ids`` (array of int) of every whole text."""
    rows = docs.select(payload(docs, text_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = rows.schema["row"].dataType
    out = T.StructType([T.StructField("row", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer)
        for batch in batches:
            ids = [bpe.encode(t) if len(t) <= leaf_chars else bpe.grown(t, leaf_chars) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids)], ["row", "ids"])

    short = rows.where(F.length("text") <= spread_chars).mapInArrow(whole, out)
    long = rows.where(F.length("text") > spread_chars)
    return short.unionAll(_encode_long(long, tokenizer, leaf_chars, out))


def _encode_long(rows: DataFrame, tokenizer: str, leaf_chars: int, out: T.StructType) -> DataFrame:
    """The same for texts of several leaves: leaves are encoded as rows, then joined text by text in order."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = bpe.cuts.split(text)
                found = [(i, p[at:at + leaf_chars]) for i, p in enumerate(parts) for at in range(0, len(p), leaf_chars)]
                for first in range(0, len(found), 64):
                    some = found[first:first + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(some)), pa.array(range(first, first + len(some)), pa.int32()),
                         pa.array([x[0] for x in some], pa.int32()), pa.array([x[1] for x in some], pa.string())],
                        ["name", "leaf", "part", "text"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer)
        for batch in batches:
            for k in range(batch.num_rows):
                part, text = batch.column(2)[k].as_py(), batch.column(3)[k].as_py()
                pieces = [(len(text), [bpe.special[text]])] if part % 2 else bpe.leaf(text)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(k, 1) for c in range(3)), _lists([[n for n, _ in pieces]]),
                     _lists([[len(i) for _, i in pieces]]), _lists([[x for _, i in pieces for x in i]])],
                    ["name", "leaf", "part", "chars", "sizes", "ids"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer)
        name, part, ids, tree = None, None, [], Tree(bpe)

        def finished() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), _lists([ids + tree.ids()])], ["name", "ids"])

        for batch in batches:
            for k in range(batch.num_rows):
                of, _, p, chars, sizes, flat = (batch.column(c)[k].as_py() for c in range(6))
                if of != name:
                    if name is not None:
                        yield finished()
                    name, part, ids, tree = of, p, [], Tree(bpe)
                elif p != part:
                    ids, part = ids + tree.ids(), p
                if p % 2:
                    ids += flat
                    continue
                at, leaf = 0, []
                for n, size in zip(chars, sizes, strict=True):
                    leaf.append((n, flat[at:at + size]))
                    at += size
                tree.add(leaf)
        if name is not None:
            yield finished()

    # a text is named by a hash of itself: equal texts are encoded once, and rows find their ids by that name
    named = rows.withColumn("name", F.sha2("text", 256))
    once = named.select("name", "text").dropDuplicates(["name"])
    parts = once.mapInArrow(leaves, "name string, leaf int, part int, text string").repartition("name", "leaf")
    done = (parts.mapInArrow(encoded, "name string, leaf int, part int, chars array<int>, sizes array<int>, ids array<int>")
            .repartition("name").sortWithinPartitions("name", "leaf").mapInArrow(joined, "name string, ids array<int>"))
    return named.select("row", "name").join(done, "name").select("row", "ids")


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """``row`` (struct of all columns) and the ``text`` that the ids spell; invalid bytes become U+FFFD."""
    rows = encoded.select(payload(encoded))
    out = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("text", T.StringType())])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer)
        for batch in batches:
            spelled = [bpe.decode(x.as_py() or []) for x in batch.column(0).field(ids_col)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spelled, pa.string())], ["row", "text"])

    return rows.mapInArrow(texts, out)


def round_trip(docs: DataFrame, tokenizer: str, text_col: str = "text", leaf_chars: int = LEAF_CHARS,
               spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """``row`` (the other columns), ``ids`` and ``decoded``: the ids of every text and the text that they spell."""
    kept = encode(docs, tokenizer, text_col, leaf_chars, spread_chars)
    spelled = decode(kept, tokenizer)
    return spelled.select(F.col("row.row").alias("row"), F.col("row.ids").alias("ids"), F.col("text").alias("decoded"))
