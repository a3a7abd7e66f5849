"""Short codes for vectors by product quantisation, learned by Heap Lloyd.

A vector's components become whole numbers, and its parts (equal consecutive cuts) are each named
by the nearest entry of that part's codebook. Codebooks are learned in rounds of Lloyd's method:
every part goes to its nearest entry, every entry to the mean of its parts, rounded down.

**Heap Lloyd.** A part keeps a lower bound of the distance to its second nearest entry and an upper
bound of that to its own. As entries drift the gap between both shrinks by no more than what its
entry and the farthest of the others have moved. So each entry sums that drift up, and has a heap of
its parts in order of the drift at which their gap closes. A round pops from each heap what the
drift has passed and compares just these parts with all entries again, exactly; the rest keep their
entry without being looked at.

Heaps belong to a block, some thousand vectors of one task, and are written with it from round to
round. A block also gives what its moved parts change in the sums of entries, so that only
those changes are shuffled, summed by entry first. The driver holds the codebooks and sums,
whose size doesn't depend on the number of vectors. Each round's table is removed when the next is
written.

All arithmetic that decides is on whole numbers: distances come from products of doubles where
those are exact, else of 64-bit integers. Bounds are floating-point and get a margin, which can
only cause needless comparisons.

Cases: rows whose vector is null or holds null or non-finite components are dropped. The usual
length of vectors is the most frequent one that divides into the parts (the smaller of equals);
vectors of other lengths, empty ones too, stay with a null code and error and teach nothing. With
fewer vectors than entries the codebooks have fewer entries. Rows that repeat an id are taken in
order of their vectors; null ids come last when codebooks begin, and are coded as others. Equal
vectors have equal codes. An empty table gives no rows. A component of 2^18 or more in size is an
error: squared distances need not fit 64 bits there. Columns other than id, vector and label are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.checkpoints import Rounds
from graphloom.llm.common import checkpointed, free_prefix

#: Greatest size of a component as a whole number.
LIMIT = 1 << 28


@dataclass(frozen=True)
class Params:
    """``parts`` of a vector, ``entries`` of a codebook, ``rounds`` of learning, ``scale`` of components.

    ``block_rows``: vectors whose heaps are kept together; ``broadcast_labels``: labels whose sums
    are broadcast, beyond which they are joined by a shuffle.
    """

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    block_rows: int = 16_384
    broadcast_labels: int = 65_536


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` (whole numbers, 64 bits) from those of ``c``."""
    size = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)), 1)
    if 4 * size * size * x.shape[1] < 1 << 53:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    return np.stack([((x - e) ** 2).sum(1) for e in c], axis=1)


class Heaps:
    """The heaps of one part position in one block: for each entry its parts by the drift that ends their bound."""

    def __init__(self, entry: np.ndarray, key: np.ndarray, entries: int):
        self.entry, self.key = entry, key
        self.member = np.lexsort((key, entry))  # ascending keys are a heap
        self.size = np.bincount(entry, minlength=entries)
        self.first = np.cumsum(self.size) - self.size

    def popped(self, drift: np.ndarray) -> np.ndarray:
        """Parts whose key is at most their entry's drift: from the roots, only below a popped part."""
        heap = np.flatnonzero(self.size)
        place, out = np.zeros(len(heap), np.int64), [np.empty(0, np.int64)]
        while len(heap):
            part = self.member[self.first[heap] + place]
            hit = self.key[part] <= drift[heap]
            out.append(part[hit])
            heap, place = np.repeat(heap[hit], 2), (2 * place[hit][:, None] + (1, 2)).ravel()
            there = place < self.size[heap]
            heap, place = heap[there], place[there]
        return np.concatenate(out)


@dataclass(frozen=True)
class Book:
    """Codebooks as they stand: ``entries`` of each part, and the drift that each entry has summed up."""

    entries: np.ndarray
    drift: np.ndarray

    def margin(self) -> float:
        """More than rounding can add to a bound."""
        return 1e-6 + 1e-9 * float(np.abs(self.entries).max(initial=0)) + 1e-12 * float(self.drift.max(initial=0))


def scanned(x: np.ndarray, book: Book, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row (ties to the lower), and the drift up to which it's sure to stay so."""
    entry, key = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), 2048):
        d = squared_distances(x[at : at + 2048], book.entries[part])
        row = np.arange(len(d))
        entry[at : at + 2048] = best = d.argmin(1)
        upper = np.sqrt(d[row, best].astype(np.float64))
        d = d.astype(np.float64)
        d[row, best] = np.inf
        key[at : at + 2048] = book.drift[part][best] + np.sqrt(d.min(1)) - upper - book.margin()
    return entry, key


def reassigned(x: np.ndarray, entry: np.ndarray, key: np.ndarray, book: Book, part: int) -> np.ndarray:
    """Sets ``entry`` and ``key`` of the parts whose bounds don't hold any more; returns those that were scanned."""
    at = Heaps(entry, key, len(book.entries[part])).popped(book.drift[part])
    entry[at], key[at] = scanned(x[at], book, part)
    return at


def _changes(part: int, x: np.ndarray, old: np.ndarray | None, new: np.ndarray) -> list[dict]:
    """What each entry gains in count and sum as parts go from ``old`` to ``new``."""
    moved = np.arange(len(new)) if old is None else np.flatnonzero(old != new)
    to, back = new[moved], new[:0] if old is None else old[moved]
    entry, rows = np.concatenate((to, back)), np.concatenate((x[moved], -x[moved][: len(back)]))
    count = np.concatenate((np.ones(len(to), np.int64), -np.ones(len(back), np.int64)))
    order = np.argsort(entry, kind="stable")
    entry, rows, count = entry[order], rows[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], entry[1:] != entry[:-1]))) if len(entry) else []
    if not len(first):
        return []
    sums, counts = np.add.reduceat(rows, first), np.add.reduceat(count, first)
    return [{"part": part, "entry": int(e), "n": int(n), "sums": s.tolist()} for e, n, s in zip(entry[first], counts, sums, strict=True)]


CHANGES = "array<struct<part:int,entry:int,n:long,sums:array<long>>>"
#: A block: its ids and labels, its components (32 bits), entries (16 bits) and keys, and the changes of the round.
BLOCK = f"ids array<long>, labels array<{{label}}>, x binary, entry binary, key binary, scanned long, changes {CHANGES}"


def _block(ids: pa.Array, labels: pa.Array, x: np.ndarray, entry: np.ndarray, key: np.ndarray, scanned_parts: int, changes: list[dict]) -> pa.RecordBatch:
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    kind = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))
    binary = [pa.array([a.tobytes()], pa.binary()) for a in (x.astype(np.int32), entry.astype(np.uint16), key)]
    names = ["ids", "labels", "x", "entry", "key", "scanned", "changes"]
    return pa.RecordBatch.from_arrays([one(ids), one(labels), *binary, pa.array([scanned_parts]), pa.array([changes], kind)], names=names)


def _first(params: Params, book: Book):
    """Rows of (id, label, v) to blocks, each part at its nearest entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, params.block_rows) for b in batches for at in range(0, b.num_rows, params.block_rows)):
            v = batch.column("v")
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = np.floor(x * params.scale)
            if np.abs(x).max(initial=0) >= LIMIT:
                raise ValueError(f"a component times {params.scale} is {LIMIT} or more in size")
            x = x.astype(np.int64).reshape(batch.num_rows, params.parts, -1)
            entry, key, changes = np.empty((params.parts, len(x)), np.int64), np.empty((params.parts, len(x))), []
            for p in range(params.parts):
                entry[p], key[p] = scanned(x[:, p], book, p)
                changes += _changes(p, x[:, p], None, entry[p])
            yield _block(batch.column("id"), batch.column("label"), x, entry, key, entry.size, changes)

    return run


def _opened(batches: Iterator[pa.RecordBatch], params: Params) -> Iterator[tuple]:
    """ids, labels, components, entries and keys of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, labels = (batch.column(c).slice(i, 1).flatten() for c in ("ids", "labels"))
            x, entry, key = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("x", np.int32), ("entry", np.uint16), ("key", np.float64)))
            yield ids, labels, x.astype(np.int64).reshape(len(ids), params.parts, -1), entry.astype(np.int64).reshape(params.parts, -1), key.reshape(params.parts, -1).copy()


def _next(params: Params, book: Book):
    """Blocks to blocks: parts that the drift has freed go to their nearest entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, x, entry, key in _opened(batches, params):
            looked, changes = 0, []
            for p in range(params.parts):
                old = entry[p].copy()
                looked += len(reassigned(x[:, p], entry[p], key[p], book, p))
                changes += _changes(p, x[:, p], old, entry[p])
            yield _block(ids, labels, x, entry, key, looked, changes)

    return run


def _codes(params: Params, book: Book):
    """Blocks to rows: ids, labels, codes and errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexes = np.array([f"{i:0{max(2, len(f'{params.entries - 1:x}'))}x}" for i in range(params.entries)])
        for ids, labels, x, entry, key in _opened(batches, params):
            error, code = np.zeros(len(ids), np.int64), np.full(len(ids), "", object)
            for p in range(params.parts):
                reassigned(x[:, p], entry[p], key[p], book, p)
                error += ((x[:, p] - book.entries[p][entry[p]]) ** 2).sum(1)
                code += hexes[entry[p]].astype(object)
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return run


def _moved(blocks: DataFrame, sums: np.ndarray, counts: np.ndarray) -> None:
    """Adds the changes of all blocks to the sums and counts of entries."""
    changes = blocks.select(F.explode("changes").alias("c")).select("c.*")
    each = changes.select("part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    for r in each.collect():  # as many as the codebooks have numbers
        sums[r["part"], r["entry"], r["at"]] += int(r["s"])
        counts[r["part"], r["entry"]] += int(r["n"]) * (r["at"] == 0)


def _updated(book: Book, sums: np.ndarray, counts: np.ndarray) -> Book:
    """Entries at the means of their parts, rounded down; drift grows by what an entry and the fastest other have moved."""
    used = counts > 0
    entries = book.entries.copy()
    entries[used] = (sums[used] // counts[used][:, None]).astype(np.int64)
    step = np.sqrt(((entries - book.entries).astype(np.float64) ** 2).sum(2)) * (1 + 1e-12)
    drift = book.drift.copy()
    for p, s in enumerate(step):
        most = np.sort(s)[::-1]
        fastest = most[0] if len(s) else 0.0
        rest = most[1] if len(s) > 1 else 0.0
        drift[p] += s + np.where(s == fastest, rest if (s == fastest).sum() == 1 else fastest, fastest)
    return Book(entries, drift)


def _sound(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def encode(vectors: DataFrame, params: Params = Params(), vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", work: list | None = None) -> DataFrame:
    """Columns ``vec_id``, ``label``, ``code``, ``error`` and ``codebooks_sha256`` of each vector that is kept.

    ``code``: the parts' entries in hexadecimal, two digits or as many as the greatest needs.
    ``error``: squared distances of the parts from their entries, summed. ``work`` gets for each
    round the number of parts that were compared with all entries.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v")).where(_sound(F.col("v")))
    kind = rows.schema["label"].dataType.simpleString()
    sizes = rows.groupBy(F.size("v").alias("size")).count().where((F.col("size") > 0) & (F.col("size") % params.parts == 0)).orderBy(F.desc("count"), "size").limit(1).collect()
    odd = rows if not sizes else rows.where(F.size("v") != sizes[0]["size"])
    odd = odd.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    digest, codes = hashlib.sha256(b"").hexdigest(), odd
    if sizes:
        rows = rows.where(F.size("v") == sizes[0]["size"])
        seeds = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(params.entries).collect()
        entries = np.floor(np.array([r["v"] for r in seeds]) * params.scale)
        if np.abs(entries).max() >= LIMIT:
            raise ValueError(f"a component times {params.scale} is {LIMIT} or more in size")
        entries = entries.astype(np.int64).reshape(len(seeds), params.parts, -1).transpose(1, 0, 2)
        book = Book(entries, np.zeros(entries.shape[:2]))
        sums, counts = np.zeros(entries.shape, object), np.zeros(entries.shape[:2], object)
        rounds, schema = Rounds(spark, "vector-codes"), BLOCK.format(label=kind)
        blocks = rows.mapInArrow(_first(params, book), schema)
        for k in range(params.rounds):
            blocks = rounds.written(blocks if k == 0 else blocks.mapInArrow(_next(params, book), schema))
            if work is not None:
                work.append(blocks.agg(F.sum("scanned")).first()[0])
            _moved(blocks, sums, counts)
            book = _updated(book, sums, counts)
        if params.rounds == 0:
            blocks = rounds.written(blocks)
        codes = checkpointed(blocks.mapInArrow(_codes(params, book), f"id long, label {kind}, code string, error long").unionByName(odd))
        rounds.drop(rounds.k)
        digest = hashlib.sha256(",".join(map(str, book.entries.ravel().tolist())).encode()).hexdigest()
    return codes.select(F.col("id").alias(vec_id), F.col("label").alias(label), "code", "error", F.lit(digest).alias("codebooks_sha256"))


def with_label_error(codes: DataFrame, params: Params = Params(), label: str = "label") -> DataFrame:
    """``codes`` with ``label_error``: the errors of all rows of an equal label, nulls together, summed."""
    p = free_prefix(codes)
    sums = codes.groupBy(F.col(label).alias(p + "label")).agg(F.sum("error").alias("label_error"))
    few = sums.limit(params.broadcast_labels + 1).count() <= params.broadcast_labels
    return codes.join(F.broadcast(sums) if few else sums, codes[label].eqNullSafe(F.col(p + "label")), "left").drop(p + "label")
