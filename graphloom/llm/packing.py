"""Best-fit packing of documents into sequences of a fixed length.

Each document becomes token ids and an end id; a document longer than a sequence is cut into
pieces of the sequence's length. The tokenizer drops white space and never merges across it,
so a text is encoded as its white-space separated words, and a word met before is looked up. The
string of a special token in a text becomes that token's id, as the tokenizer has it.

Only the pieces' numbers are shuffled, never text or ids, dealt evenly to packers by their
count. A packer takes its pieces longest first and packs them online: a fixed number of open
bins, found through a bitset keyed by free space; a piece goes to the bin with the least space
that takes it, and if all places are taken the fullest bin closes first.

Cases: a null text counts as empty and is the end id alone. Repeated rows are packed each on
its own. A very long text is cut into full pieces and a rest. Pieces of one length go in the order of
document, piece and ids; of bins with the same free space the one filled last takes a piece. An
empty table gives no rows. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    """``pieces_per_packer``: documents for each packing task; ``open_bins``: bins open at once."""

    tokenizer: str
    max_tokens: int = 2048
    end_id: int = 0
    pieces_per_packer: int = 32_768
    open_bins: int = 8192
    cached_words: int = 600_000


class WordEncoder(dict):
    """Token ids of words, as bytes of little-endian unsigned 32-bit numbers.

    The words met first, among which are the frequent ones, are kept up to a number.
    """

    def __init__(self, path: str, cached_words: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        self.tokenizer, self.most = Tokenizer.from_file(path), cached_words

    def __missing__(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < self.most:
            self[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, text.encode("utf-8", "replace").split())) if text else b""


@lru_cache(maxsize=1)
def _encoder(path: str, cached_words: int) -> WordEncoder:
    """The encoder of a Python worker, with the words that its earlier tasks met."""
    return WordEncoder(path, cached_words)


PIECES = "piece int, start long, length long, ids_crc32 long"


def _cut_partition(params: Params):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(params.tokenizer, params.cached_words)
        end, size = np.array([params.end_id], "<u4").tobytes(), 4 * params.max_tokens
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.encode(text) + end
                for k, lo in enumerate(range(0, len(ids), size)):
                    piece = ids[lo : lo + size]
                    at.append(i)
                    rows.append((k, lo // 4, len(piece) // 4, zlib.crc32(piece)))
            if rows:
                piece, start, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=[batch.schema.names[0], "piece", "start", "length", "ids_crc32"],
                )

    return cut


class BestFit:
    """Bounded-space online best fit. ``place`` gives a bin's number and the offset in it."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
        self.bits = 0  # bit f is set if a bin with free space f is open
        self.n_open = self.n_bins = 0

    def _take(self, space: int) -> int:
        found = self.free[space].pop()
        if not self.free[space]:
            self.bits &= ~(1 << space)
        self.n_open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.n_open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            space, number = self.capacity, self.n_bins
            self.n_bins += 1
        if space > length:
            self.free[space - length].append(number)
            self.bits |= 1 << (space - length)
            self.n_open += 1
        return number, self.capacity - space


def _pack_partition(params: Params):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = BestFit(params.max_tokens, params.open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            if placed:
                number, offset = zip(*placed, strict=True)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([first + x for x in number], pa.int64()), pa.array(offset, pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    return pack


def cut(docs: DataFrame, params: Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: its document's id, number, start, length and the ids' crc32."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(_cut_partition(params), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {PIECES}")


def pack(docs: DataFrame, params: Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces with the sequence each is in and its place there."""
    packers = max(1, math.ceil(docs.count() / params.pieces_per_packer))
    dealt = cut(docs, params, id_col, text_col).repartition(packers)
    ordered = dealt.sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
    return ordered.mapInArrow(_pack_partition(params), f"doc_id {dealt.schema['doc_id'].dataType.simpleString()}, {PIECES}, sequence_id long, offset long")
