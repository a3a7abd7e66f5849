"""Language-model scoring by context-tree weighting over bytes, beside a word baseline.

A text is scored as its words, lower-cased in A-Z, each followed by a space, and an end byte.
A byte is eight binary decisions; each context (the last 0 to ``depth`` bytes) and decision has
Krichevsky-Trofimov estimates from the training counts, and context-tree weighting mixes the
estimates of all depths: at a context the own estimate and the product of its children's are
weighed by how well each codes the training bytes. What is learned is fixed before scoring, so
the mixed probability of a byte in a context is one number, looked up.

Training counts words and byte n-grams over all training texts; Spark sums them. Every context
that stands in the training texts is learned, at each depth, however rare. N-grams are dealt to
slots by the last two bytes of their context, so a slot has all longer contexts of its own and
weighs them alone; of depths 0 and 1 there are 257 contexts at most, whose sums go to the driver.
Nothing else of the tree leaves the slots: texts are scored in chunks, each chunk asks the slots for
its distinct n-grams and gets their probabilities. Words are counted likewise: those of at
least a ``1 / frequent`` share (at most ``frequent`` of them) are broadcast, and all others are
joined with their counts.

Cases: a null text counts as empty: no words, only the end. Without any training text all bytes
are equally likely. Repeated rows are learned from and scored as often as they occur. An empty
table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpointed

END = b"\n"
#: What bytes count as: A-Z as a-z, and all that parts words as a space.
AS = np.arange(256, dtype=np.uint8)
AS[ord("A") : ord("Z") + 1] += 32
AS[9:14] = ord(" ")
LOG10 = math.log(10)


@dataclass(frozen=True)
class Params:
    """``depth`` of contexts is at most 6: an n-gram of one byte more is packed into a long.
    ``chunk``: bytes of text that are scored together; ``packed``: bytes of text that a task holds
    to pack them; ``frequent``: at most so many words are broadcast."""

    depth: int = 6
    chunk: int = 8 << 20
    frequent: int = 1 << 20
    flush: int = 300_000
    packed: int = 16 << 20
    held_grams: int = 1_500_000


def normal_words(text: bytes | None) -> list[bytes]:
    """The words of a text; many texts at a time go through ``_streams``."""
    return text.lower().split() if text else []


def stream(words: list[bytes]) -> bytes:
    """The bytes that a text is scored as."""
    return b" ".join([*words, END])


def _packed(data: np.ndarray, depth: int) -> np.ndarray:
    """The n-grams of ``depth + 1`` bytes that end at each place from ``depth`` on."""
    data = np.concatenate((data, np.zeros(8, np.uint8)))
    key = np.ndarray((len(data) - 8 - depth,), "<u8", data, 0, (1,)).byteswap()  # the eight bytes from each place on
    key >>= np.uint64(8 * (7 - depth))
    return key.view(np.int64)


def _streams(texts: list[bytes | None], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The streams of some texts, one behind the other, their lengths, and the n-grams that end at each of their bytes."""
    tail = b" " + END * (depth + 1)  # the end, and as many before the next text as its first contexts reach back
    data = AS[np.frombuffer(b"".join([x for t in texts for x in (t or b"", tail)]), np.uint8)]
    sizes = np.array([len(t or b"") for t in texts]) + len(tail)
    ends = np.cumsum(sizes)
    data[(ends[:, None] - 1 - np.arange(depth + 1)).reshape(-1)] = END[0]
    word = data != ord(" ")
    kept = word.copy()  # and a space behind each word
    kept[1:] |= word[:-1] & (data[:-1] != END[0])
    data = data[kept]
    lengths = np.add.reduceat(kept, ends - sizes, dtype=np.int64) - depth
    inside = np.ones(len(data), bool)
    inside[(np.cumsum(lengths + depth)[:, None] - 1 - np.arange(depth)).reshape(-1)] = False
    return data[inside], lengths, _packed(np.concatenate((np.frombuffer(END * depth, np.uint8), data)), depth)[inside]


def _blocks(texts: Iterable[bytes | None], depth: int, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``_streams`` of some texts at a time."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or b"") + 1
        if size > most:
            yield _streams(held, depth)
            held, size = [], 0
    if held:
        yield _streams(held, depth)


def _words(data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of streams, each with its space, the ends of texts as words of their own, and how many each text has."""
    last = np.flatnonzero((data == ord(" ")) | (data == END[0]))
    starts = np.concatenate(([0], last + 1)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(last), [None, pa.py_buffer(starts), pa.py_buffer(data)]), np.diff(np.flatnonzero(data[last] == END[0]), prepend=-1)


def _column(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes | None]:
    for batch in batches:
        yield from batch.column(0).to_pylist()


def _words_partition(params: Params):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for data, *_ in _blocks(_column(batches), 0):
            found = _words(data)[0].value_counts()
            held.append(pa.table([found.field("values"), found.field("counts")], names=["word", "n"]))
            if sum(map(len, held)) > 2 * params.flush:
                held = [summed()]
                if len(held[0]) > params.flush:
                    yield from held.pop().combine_chunks().to_batches()
        if held:
            yield from summed().combine_chunks().to_batches()

    return count


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


def _slot(grams: np.ndarray, slots: int) -> np.ndarray:
    """By the last two bytes of the context, so that a slot has all of a longer context."""
    return ((((grams >> 8) & 0xFFFF).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % slots


def _grams_partition(params: Params, slots: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def dealt() -> pa.RecordBatch:
            keys, n = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
            parts.clear()
            slot = _slot(keys, slots)
            order = np.argsort(slot, kind="stable")
            ends = np.searchsorted(slot[order], np.arange(slots + 1))
            some = np.flatnonzero(np.diff(ends))
            own = [order[ends[i] : ends[i + 1]] for i in some]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([_pressed(keys[x], True) for x in own], pa.binary()), pa.array([_pressed(n[x]) for x in own], pa.binary())], names=["slot", "grams", "n"])

        for *_, keys in _blocks(_column(batches), params.depth):
            parts.append(np.unique(keys, return_counts=True))
            if sum(len(k) for k, _ in parts) > params.held_grams:
                yield dealt()
        if parts:
            yield dealt()

    return count


def _flat(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[x.flatten().to_numpy(zero_copy_only=False) for x in column.chunks]])


def _pressed(values: np.ndarray, ascending: bool = False) -> bytes:
    """Integers with all their first bytes together, then all second ones and so on, as zstd."""
    values = values.astype(np.int64)
    if ascending:
        values = np.diff(values, prepend=0)
    return len(values).to_bytes(8, "little") + pa.compress(values.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _loose(column: pa.ChunkedArray, ascending: bool = False) -> list[np.ndarray]:
    out = []
    for x in column.to_pylist():
        n = int.from_bytes(x[:8], "little")
        values = np.frombuffer(pa.decompress(x[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n).T.copy().view(np.int64).reshape(-1)
        out.append(np.cumsum(values) if ascending else values)
    return out


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *parts])


def _pressed_logs(values: np.ndarray) -> bytes:
    """Float32 numbers with all their first bytes together, and so on, as zstd."""
    return len(values).to_bytes(8, "little") + pa.compress(values.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _loose_logs(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    return np.frombuffer(pa.decompress(packed[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n).T.copy().view(np.float32).reshape(-1)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of places by key, the key of each run of equal ones, and the lengths of runs.

    Places are sorted as the lower bits of hashes, which is faster than to sort them by key. Keys whose hashes clash may have several runs.
    """
    bits = np.uint64(len(keys).bit_length())
    mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed >>= bits
    mixed <<= bits
    mixed |= np.arange(len(keys), dtype=np.uint64)
    mixed.sort()
    mixed &= (np.uint64(1) << bits) - np.uint64(1)
    order = mixed.astype(np.int32 if len(keys) < 1 << 31 else np.int64)
    found = keys[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), found[1:] != found[:-1])))
    return order, found[first], np.diff(first, append=len(keys)).astype(order.dtype)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of x >= 0.5, by Stirling's series from x + 8 on."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    return series - np.log(shift)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the KT probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - math.log(math.pi)


#: Logarithms of the gamma function at n + 1/2 and n + 1.
HALVES, WHOLES = log_gamma(np.arange(1 << 16) + 0.5), log_gamma(np.arange(1 << 16) + 1.0)


def log_kt_of(zeros: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``log_kt`` of integers, mostly small."""
    big = np.flatnonzero(total >= len(WHOLES))
    z, t = zeros.copy(), total.copy()
    z[big] = t[big] = 0
    out = HALVES[z] + HALVES[t - z] - WHOLES[t] - math.log(math.pi)
    out[big] = log_kt(zeros[big].astype(np.float64), (total - zeros)[big].astype(np.float64))
    return out


def decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 255 decisions of a byte, from counts of bytes (rows x 256)."""
    zeros, ones = [], []
    for level in range(8):
        halves = counts.reshape(len(counts), 1 << level, 2, 128 >> level).sum(axis=3, dtype=np.float64)
        zeros.append(halves[:, :, 0])
        ones.append(halves[:, :, 1])
    return np.concatenate(zeros, axis=1), np.concatenate(ones, axis=1)


def byte_logs(p_one: np.ndarray) -> np.ndarray:
    """log10 probabilities of the 256 bytes from those of a one at each decision."""
    out = np.zeros((len(p_one), 256))
    for level in range(8):
        p = p_one[:, (1 << level) - 1 : (2 << level) - 1]
        both = np.log10(np.stack([1 - p, p], axis=2)).reshape(len(p), 2 << level)
        out += np.repeat(both, 256 >> (level + 1), axis=1)
    return out


@dataclass(frozen=True)
class Tree:
    """The contexts of depth 0 and 1, by the last byte. ``mixed`` and ``left`` at each of the 255
    decisions: what these depths give to the probability of a one, and the share that longer
    contexts have. ``logs[last, byte]``: log10 probability where no longer context is known."""

    mixed: np.ndarray
    left: np.ndarray
    logs: np.ndarray


def build(counts: np.ndarray, below: np.ndarray, depth: int) -> Tree:
    """From counts of last and next bytes, and the weighted logarithms of the depth-2 contexts."""
    mixed, left = np.zeros((1, 255)), np.ones((1, 255))
    tables, sums = [counts.sum(axis=0, keepdims=True), counts][: depth + 1], [None, below]
    own_share, ones_share = [], []
    for d in range(len(tables) - 1, -1, -1):
        zeros, ones = decisions(tables[d])
        own = log_kt(zeros, ones)
        weighted = own if d == depth else math.log(0.5) + np.logaddexp(own, sums[d])
        own_share.insert(0, np.exp((0.0 if d == depth else math.log(0.5)) + own - weighted))
        ones_share.insert(0, (ones + 0.5) / (zeros + ones + 1))
        if d:
            sums[d - 1] = weighted.sum(axis=0, keepdims=True)
    for share, one in zip(own_share, ones_share, strict=True):
        mixed, left = mixed + left * share * one, left * (1.0 - share)
    mixed, left = (np.broadcast_to(x, (256, 255)).copy() for x in (mixed, left))
    return Tree(mixed, left, byte_logs(np.clip(mixed + left / 2, 1e-12, 1 - 1e-12)).astype(np.float32))


def _by_depth(grams: np.ndarray, n: np.ndarray, depth: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Distinct n-grams, ascending, and their counts, with contexts of ``depth`` to 2 bytes."""
    out = {}
    for d in range(depth, 1, -1):
        grams, n = out[d] = _summed(grams & ((1 << (8 * (d + 1))) - 1), n)
    return out


@dataclass(frozen=True)
class Nodes:
    """One decision of the next byte at all contexts of a depth. ``keys``: a context and the bits
    so far, ascending; ``parent``: the place of the context one byte shorter."""

    keys: np.ndarray
    one: np.ndarray
    own_share: np.ndarray
    weighted: np.ndarray
    parent: np.ndarray | None


def _weigh(grams: dict[int, tuple[np.ndarray, np.ndarray]], depth: int, level: int) -> dict[int, Nodes]:
    """Of each depth from 2 on, the nodes at decision ``level`` of the next byte."""
    found = {}
    for d, (keys, n) in grams.items():
        at = keys >> (8 - level)
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), at[1:] != at[:-1])))
        if len(first):
            total, ones = np.add.reduceat(n, first), np.add.reduceat(n * ((keys >> (7 - level)) & 1), first)
        else:
            total = ones = np.zeros(0, np.int64)
        found[d] = at[first], total, ones
    out: dict[int, Nodes] = {}
    weighted = None
    for d in range(depth, 1, -1):
        keys, total, ones = found[d]
        own = log_kt_of(total - ones, total)
        if d == depth:
            weighted, share = own, np.ones(len(own))
        else:  # each n-gram stands in contexts of all depths, so children have all of a context's counts
            below = np.bincount(np.searchsorted(keys, found[d + 1][0] & ((1 << (8 * d + level)) - 1)), weighted, len(keys))
            weighted = math.log(0.5) + np.logaddexp(own, below)
            share = np.exp(math.log(0.5) + own - weighted)
        parent = np.searchsorted(found[d - 1][0], keys & ((1 << (8 * (d - 1) + level)) - 1)) if d > 2 else None
        out[d] = Nodes(keys, (ones + 0.5) / (total + 1), share, weighted, parent)
    return out


def _at_top(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Last byte and decision of nodes."""
    return (keys >> level) & 255, (1 << level) - 1 + (keys & ((1 << level) - 1))


def _slot_sums(params: Params):
    """A slot's n-grams with their counts, and what it adds to the contexts of one byte."""

    def sums(table: pa.Table) -> pa.Table:
        slot = table.column("slot")[0].as_py()
        grams, n = _summed(_joined(_loose(table.column("grams"), True)), _joined(_loose(table.column("n"))))
        grams_of = _by_depth(grams, n, params.depth)
        counts = np.zeros((256, 256), np.int64)
        np.add.at(counts, ((grams >> 8) & 255, grams & 255) if params.depth else (0, grams), n)
        below = np.zeros((256, 255))
        for level in range(8):
            if params.depth >= 2:
                two = _weigh(grams_of, params.depth, level)[2]
                np.add.at(below, _at_top(two.keys, level), two.weighted)
        cuts = range(0, len(grams), 1 << 18)
        some = np.flatnonzero(counts.sum(axis=1))
        none = [None]
        return pa.table(
            [
                pa.array([slot] * (len(cuts) + len(some)), pa.int32()),
                pa.array([-1] * len(cuts) + some.tolist(), pa.int32()),
                pa.array([_pressed(grams[i : i + (1 << 18)], True) for i in cuts] + none * len(some), pa.binary()),
                pa.array([_pressed(n[i : i + (1 << 18)]) for i in cuts] + [_pressed(x) for x in counts[some]], pa.binary()),
                pa.array(none * len(cuts) + list(below[some]), pa.list_(pa.float64())),
            ],
            names=["slot", "last", "grams", "n", "below"],
        )

    return sums


def _top_sums(table: pa.Table) -> pa.Table:
    n, below = sum(_loose(table.column("n"))), _flat(table.column("below"), np.float64).reshape(-1, 255).sum(axis=0)
    return pa.table([table.column("last")[:1], pa.array([n], pa.list_(pa.int64())), pa.array([below], pa.list_(pa.float64()))], names=["last", "n", "below"])


def _probabilities(grams: dict[int, tuple[np.ndarray, np.ndarray]], tree: Tree, depth: int, asked: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each n-gram of ``asked`` (ascending), given the others."""
    logs = np.zeros(len(asked))
    for level in range(8):
        last, at = ((asked >> 8) & 255 if depth else np.zeros(len(asked), np.int64)), (1 << level) - 1 + ((asked & 255) >> (8 - level))
        p = tree.mixed[last, at] + tree.left[last, at] / 2
        nodes = _weigh(grams, depth, level)
        known: dict[int, np.ndarray] = {}
        for d in range(2, depth + 1):
            x = nodes[d]
            if d == 2:
                up = tree.mixed[_at_top(x.keys, level)], tree.left[_at_top(x.keys, level)]
            else:
                up = mixed[x.parent], left[x.parent]
            mixed, left = up[0] + up[1] * x.own_share * x.one, up[1] * (1.0 - x.own_share)
            known[d] = mixed + left / 2
        open_ = np.arange(len(asked))
        for d in range(depth, 1, -1):  # the longest context that is known
            if not len(open_) or not len(nodes[d].keys):
                continue
            keys = (asked[open_] >> (8 - level)) & ((1 << (8 * d + level)) - 1)
            place = np.minimum(np.searchsorted(nodes[d].keys, keys), len(nodes[d].keys) - 1)
            hit = nodes[d].keys[place] == keys
            p[open_[hit]] = known[d][place[hit]]
            open_ = open_[~hit]
        p = np.clip(p, 1e-12, 1 - 1e-12)
        logs += np.log10(np.where((asked >> (7 - level)) & 1, p, 1 - p))
    return logs


@dataclass(frozen=True)
class Model:
    tree: Tree
    grams: DataFrame  # slot, grams, n
    slots: int
    words: DataFrame  # word, n
    tokens: int
    vocabulary: int
    frequent: dict[bytes, int]
    params: Params


def fit(train: DataFrame, params: Params = Params(), text_col: str = "text") -> Model:
    """Learns from all rows of ``train``."""
    texts = train.select(F.col(text_col).cast("binary").alias("t"))
    words = checkpointed(texts.mapInArrow(_words_partition(params), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    frequent = words.where(F.col("n") * params.frequent >= total["n"]).toPandas()
    return Model(*_tree(texts, params), words, total["n"], total["v"], dict(zip(map(bytes, frequent["word"]), frequent["n"].tolist(), strict=True)), params)


def _tree(texts: DataFrame, params: Params) -> tuple[Tree, DataFrame, int]:
    """The top of the tree, all n-grams by slot, and the number of slots.

    N-grams are counted in each task and dealt by their context to slots, of which there are as
    many as tasks, so that a slot stays as large when the input grows.
    """
    slots = max(48, texts.rdd.getNumPartitions())
    parts = texts.mapInArrow(_grams_partition(params, slots), "slot int, grams binary, n binary")
    rows = checkpointed(parts.groupBy("slot").applyInArrow(_slot_sums(params), "slot int, last int, grams binary, n binary, below array<double>"))
    counts, below = np.zeros((256, 256)), np.zeros((256, 255))
    tops = rows.where("last >= 0").select("last", "n", "below").groupBy("last").applyInArrow(_top_sums, "last int, n array<long>, below array<double>")
    for r in tops.collect():
        counts[r["last"]], below[r["last"]] = r["n"], r["below"]
    return build(counts, below, params.depth), rows.where("last < 0").select("slot", "grams", "n"), slots


def _packed_texts(texts: list[bytes | None]) -> bytes:
    lengths = np.array([len(t or b"") for t in texts], "<i4").tobytes()
    raw = lengths + b"".join([t for t in texts if t])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _loose_texts(packed: bytes, n: int) -> list[bytes]:
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)
    ends = (4 * n + np.cumsum(np.frombuffer(raw, "<i4", n))).tolist()
    return [raw[a:b] for a, b in zip([4 * n, *ends], ends, strict=False)]


def _pack_partition(params: Params):
    """The documents of a task by chunk, their texts compressed together."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            chunk = table.column("chunk").to_numpy()
            order = np.argsort(chunk, kind="stable")
            ends = np.searchsorted(chunk[order], some := np.unique(chunk), "right").astype(np.int32)
            texts = table.column("t").take(pa.array(order)).to_pylist()
            structs = pa.concat_arrays(table.column("row").chunks).take(pa.array(order))
            cuts = [0, *ends.tolist()]
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), structs)
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), lists, pa.array([_packed_texts(texts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["chunk", "rows", "texts"])

        for batch in batches:
            held.append(batch)
            size += batch.column("t").nbytes
            if size > params.packed:
                yield rows()
                size = 0
        if sum(map(len, held)):
            yield rows()

    return pack


def _texts(table: pa.Table) -> list[bytes]:
    """The texts of a chunk, in the order of its rows."""
    return [t for packed, rows in zip(table.column("texts"), table.column("rows"), strict=True) for t in _loose_texts(packed.as_py(), len(rows))]


def _asked(texts: list[bytes], depth: int, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of texts by slot, ascending in each, with the slots and their ends."""
    grams = _distinct(np.concatenate([_distinct(keys) for *_, keys in _blocks(texts, depth)]))
    slot = _slot(grams, slots)
    n = np.bincount(slot, minlength=slots)
    return grams[np.argsort(slot, kind="stable")], np.cumsum(n), np.flatnonzero(n)


def _ask(params: Params, slots: int):
    """The distinct n-grams of a chunk, by slot."""

    def ask(table: pa.Table) -> pa.Table:
        grams, last, some = _asked(_texts(table), params.depth, slots)
        chunk = pa.array(np.full(len(some), table.column("chunk")[0].as_py(), np.int32))
        first = np.concatenate(([0], last))
        return pa.table([chunk, pa.array(some.astype(np.int32)), pa.array([_pressed(grams[first[i] : last[i]], True) for i in some], pa.binary())], names=["chunk", "slot", "grams"])

    return ask


def _answer(shared):
    """Probabilities of the n-grams that chunks ask a slot for, in the order they were asked."""

    def answer(known: pa.Table, asked: pa.Table) -> pa.Table:
        tree, *_, depth = shared.value
        grams = _by_depth(_joined(_loose(known.column("grams"), True)), _joined(_loose(known.column("n"))), depth)
        parts = _loose(asked.column("grams"), True)
        wanted = _distinct(_joined(parts))
        logs = _probabilities(grams, tree, depth, wanted).astype(np.float32)
        answers = pa.array([_pressed_logs(logs[np.searchsorted(wanted, x)]) for x in parts], pa.binary())
        return pa.table([asked.column("chunk"), asked.column("slot"), answers], names=["chunk", "slot", "logs"])

    return answer


#: What scoring gives: a row for each document, and rows of its rare words, of which only their number and times are set.
PARTS = "k long, word binary, times long, n_tokens long, n_known long, base double, score double, n_bytes long"


def _sums(grams: np.ndarray, logs: np.ndarray, lengths: np.ndarray, order: np.ndarray, heads: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each text, the sum of ``logs`` over its places, given the runs of these (``_runs``)."""
    ascending = np.argsort(heads)
    at = np.empty(len(heads), np.int64)
    at[ascending] = np.searchsorted(grams, heads[ascending])
    found = np.empty(len(order))
    found[order] = np.repeat(logs[at], n)
    return np.add.reduceat(found, np.cumsum(lengths) - lengths)


def _score_chunk(shared, slots: int):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        _, frequent, tokens, vocabulary, depth = shared.value
        unit = math.log10(tokens + vocabulary + 1)
        texts_of = _texts(docs)
        ids = pa.concat_arrays([x.flatten() for x in docs.column("rows").chunks])
        ids = pa.StructArray.from_arrays(ids.flatten(), names=[f.name for f in ids.type])  # all fields nullable, as Spark expects them back
        k0, blocks, rare, whole = docs.column("chunk")[0].as_py() << 32, [], [], []
        first = k0
        for data, lengths, keys in _blocks(texts_of, depth, 1 << 20):
            blocks.append((lengths, *_runs(keys)))
            words, n = _words(data)
            words = words.dictionary_encode()
            word, names = words.indices.to_numpy(), words.dictionary
            logs = np.array([frequent.get(w, 0.0) for w in names.to_pylist()])[word]  # above 0 if known
            starts = np.cumsum(n) - n
            whole.append((n, np.add.reduceat(logs > 0, starts, dtype=np.int64), np.add.reduceat(logs, starts) - unit * n, lengths))
            # the counts of others are joined
            others, times = np.unique(np.repeat(np.arange(len(n)), n)[logs == 0] * len(names) + word[logs == 0], return_counts=True)
            rare.append(pa.table([pa.array(first + others // len(names)), names.take(pa.array(others % len(names))), pa.array(times)], names=["k", "word", "times"]))
            first += len(n)
        rare = pa.concat_tables(rare)
        n_tokens, known, base, n_bytes = map(np.concatenate, zip(*whole, strict=True))
        grams = _distinct(np.concatenate([heads for *_, heads, _ in blocks]))
        order = np.argsort(answers.column("slot").to_numpy(), kind="stable")
        logs = np.zeros(len(grams), np.float32)
        logs[np.argsort(_slot(grams, slots), kind="stable")] = np.concatenate([_loose_logs(x) for x in answers.column("logs").take(pa.array(order)).to_pylist()])
        sums = np.concatenate([_sums(grams, logs, *block) for block in blocks])
        names = ["row", "k", "word", "times", "n_tokens", "n_known", "base", "score", "n_bytes"]
        types = [ids.type, *[pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]]
        # a document's own row has a word that no text has (words begin with no space), so that no task gets all of them
        own = [b" %d" % i for i in range(len(ids))]
        first = [ids, pa.array(np.arange(len(ids)) + k0), pa.array(own, pa.binary()), pa.nulls(len(ids), pa.int64()), *[pa.array(c, t) for c, t in zip((n_tokens, known, base, sums, n_bytes), types[4:], strict=True)]]
        n = len(rare)
        rest = [pa.nulls(n, ids.type), *rare.columns, *[pa.nulls(n, t) for t in types[4:]]]
        return pa.concat_tables([pa.table(first, names=names), pa.table(rest, names=names)])

    return score


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """Of each document n_tokens, n_known, train_tokens, base_score, score and bits_per_byte."""
    params = model.params
    shared = docs.sparkSession.sparkContext.broadcast((model.tree, {w: math.log10(n + 1) for w, n in model.frequent.items()}, model.tokens, model.vocabulary, params.depth))
    text = F.col(text_col).cast("binary")
    # text bytes, and the end of each text
    size = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 1), F.lit(0))).first()[0]
    # by a hash of the content, so that a row is in the same chunk whenever it is read
    chunk = F.pmod(F.xxhash64(F.col(id_col), text), F.lit(1 + size // params.chunk)).cast("int").alias("chunk")
    rows = docs.select(chunk, F.struct(F.col(id_col).alias("doc_id"), (F.lit(False) if held_out is None else held_out).alias("held_out")).alias("row"), text.alias("t"))
    kind = rows.schema["row"].dataType.simpleString()
    packed = rows.mapInArrow(_pack_partition(params), f"chunk int, rows array<{kind}>, texts binary")
    # from the same rows as the scores, so that Spark deals the texts only once
    asked = packed.groupBy("chunk").applyInArrow(_ask(params, model.slots), "chunk int, slot int, grams binary")
    answers = model.grams.groupBy("slot").cogroup(asked.groupBy("slot")).applyInArrow(_answer(shared), "chunk int, slot int, logs binary")
    parts = packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score_chunk(shared, model.slots), f"row {kind}, {PARTS}")
    counts = model.words.select("word", F.col("n").alias("c"))
    joined = parts.join(counts, "word", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = joined.groupBy("k").agg(
        F.first("row", ignorenulls=True).alias("row"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + zero(F.when(F.col("c").isNotNull(), F.col("times")))).alias("n_known"),
        (F.sum("base") + zero(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1))).alias("base_score"),
        F.sum("score").alias("score"),
        F.sum("n_bytes").alias("n_bytes"),
    )
    bits = (-F.col("score") * LOG10 / math.log(2) / F.col("n_bytes")).alias("bits_per_byte")
    return out.select("row.doc_id", "row.held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", bits)
