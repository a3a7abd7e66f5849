"""Ranks that nodes share among those they point to, round by round, over cells of nodes.

A cell has the edges that begin in it as arrays, in the order of the nodes they go to, and knows in which order
other cells send to its own. So a round is one shuffle of bare numbers: a cell adds up what came to its nodes, and sends
each node's share on, summed by the node it goes to. The edges are shuffled once, as all rounds read the same ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.checkpoints import Rounds, cut
from graphloom.operators.cells import HELD, LEAST, placed

#: What rows are: some edges, a cell's edges, the nodes that a cell sends to, and what it sends.
RAW, OUT, INTO, SENT = 0, 1, 2, 3
ARRAYS = {"a": np.int64, "b": np.int64, "at": np.int32, "first": np.int32, "to": np.int32, "ends": np.int64, "w": np.float64}
ROWS = f"cell int, kind int, sender int, {', '.join(f'{c} binary' for c in ARRAYS)}"
SCHEMA = pa.schema([("cell", pa.int32()), ("kind", pa.int32()), ("sender", pa.int32()), *[(c, pa.binary()) for c in ARRAYS]])


def _row(cell: int, kind: int, sender: int, **arrays: np.ndarray) -> dict:
    return {"cell": cell, "kind": kind, "sender": sender, **{c: v.astype(ARRAYS[c], copy=False).tobytes() for c, v in arrays.items()}}


def _out(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, SCHEMA) if rows else SCHEMA.empty_table()


def _flat(table: pa.Table, kind: int, column: str) -> np.ndarray:
    """The arrays of all rows of a kind, by sender."""
    own = np.flatnonzero(table.column("kind").to_numpy() == kind)
    own = own[np.argsort(table.column("sender").to_numpy()[own], kind="stable")]
    return np.concatenate([np.zeros(0, ARRAYS[column]), *[np.frombuffer(x, ARRAYS[column]) for x in table.column(column).take(pa.array(own)).to_pylist()]])


def _cuts(cells: np.ndarray) -> list[int]:
    """Where another cell begins, and the end."""
    return [*np.flatnonzero(np.diff(cells, prepend=-1)).tolist(), len(cells)]


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges by the cell they begin in; one that goes to no node counts as going to -1."""
    held: list[pa.RecordBatch] = []

    def rows() -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        held.clear()
        a, b, n = table.column("a").to_numpy(), table.column("b").fill_null(-1).to_numpy(), table.column("n").to_numpy()
        order = np.argsort(a >> 32, kind="stable")
        a, b, n = a[order], b[order], n[order]
        cuts = _cuts(a >> 32)
        return _out([_row(int(a[i] >> 32), RAW, 0, a=a[i:j], b=b[i:j], w=n[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]).combine_chunks().to_batches()

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) > HELD:
            yield from rows()
    if sum(map(len, held)):
        yield from rows()


def _built(table: pa.Table) -> pa.Table:
    """A cell's edges, and for other cells the nodes it sends to, from all edges that begin in it."""
    cell = table.column("cell")[0].as_py()
    at, b = _flat(table, RAW, "a") & 0xFFFFFFFF, _flat(table, RAW, "b")
    fan_out, times = np.bincount(at), np.ones(int(at.max()) + 1)
    times[at] = _flat(table, RAW, "w")
    order = np.argsort(b, kind="stable")
    order = order[np.searchsorted(b[order], 0) :]
    at, b = at[order], b[order]
    first = np.flatnonzero(np.diff(b, prepend=-1))
    ends = b[first]
    cuts = _cuts(ends >> 32)
    to = ends[cuts[:-1]] >> 32
    rows = [_row(int(c), INTO, cell, at=ends[i:j] & 0xFFFFFFFF) for c, i, j in zip(to, cuts[:-1], cuts[1:], strict=True)]
    return _out([_row(cell, OUT, cell, at=at, first=first, to=to, ends=np.array(cuts), w=fan_out / times), *rows])


def _sent(links: pa.Table, ranks: np.ndarray) -> pa.Table:
    """What a cell sends to others, given its nodes' ranks."""
    at, first, to, cuts, fan_out = (_flat(links, OUT, c) for c in ("at", "first", "to", "ends", "w"))
    if not len(at):
        return SCHEMA.empty_table()
    share = ranks[: len(fan_out)] / np.where(fan_out > 0, fan_out, 1.0)
    sums, cell = np.add.reduceat(share[at], first), links.column("cell")[0].as_py()
    return _out([_row(int(c), SENT, cell, w=sums[i:j]) for c, i, j in zip(to, cuts[:-1], cuts[1:], strict=True)])


def _ranks(links: pa.Table, came: pa.Table | None, damping: float) -> tuple[np.ndarray, np.ndarray]:
    """The places of a cell's nodes that others point to, and the ranks of all its nodes."""
    into, n = _flat(links, INTO, "at"), len(_flat(links, OUT, "w"))
    n = max(n, int(into.max(initial=-1)) + 1)
    sums = np.zeros(n) if came is None else np.bincount(into, _flat(came, SENT, "w"), n)
    return into, (1.0 - damping) + damping * sums


def shared(nodes: DataFrame, edges: DataFrame, rounds: int, damping: float) -> DataFrame:
    """``node`` and ``pageRank``, each 1 - d at first, after so many rounds of ``1 - d + d * sum(rank / fanOut)``.

    ``nodes`` are distinct and not null, with the number ``n`` of times that each gives its shares. Edges (src, dst) count as often as they occur, and to their source's ``fanOut``
    also if they go to no node.
    """
    kept = Rounds(nodes.sparkSession, "links", keep=None)
    pairs = kept.written(edges.select("src", "dst").where("src IS NOT NULL"))
    ids = placed(nodes, max(LEAST, math.ceil(pairs.count() / HELD)))
    begin, end = ids.select(F.col("node").alias("src"), F.col("id").alias("a"), "n"), ids.select(F.col("node").alias("dst"), F.col("id").alias("b"))
    raw = pairs.join(begin.hint("merge"), "src").join(end.hint("merge"), "dst", "left").select("a", "b", "n").mapInArrow(_by_cell, ROWS)
    links = kept.written(raw.groupBy("cell").applyInArrow(_built, ROWS))

    def first(own: pa.Table) -> pa.Table:
        return _sent(own, np.full(len(_flat(own, OUT, "w")), 1.0 - damping))

    def onward(own: pa.Table, came: pa.Table) -> pa.Table:
        return _sent(own, _ranks(own, came, damping)[1])

    def last(own: pa.Table, came: pa.Table) -> pa.Table:
        into, ranks = _ranks(own, came, damping)
        at = np.unique(into)
        return pa.table([pa.array((own.column("cell")[0].as_py() << 32) + at.astype(np.int64)), pa.array(ranks[at])], names=["id", "pageRank"])

    own = links.groupBy("cell")
    sent = own.applyInArrow(first, ROWS)
    for _ in range(rounds - 1):
        sent = own.cogroup(sent.groupBy("cell")).applyInArrow(onward, ROWS)
    ranks = own.cogroup(sent.groupBy("cell")).applyInArrow(last, "id long, pageRank double")
    found = cut(ids.join(ranks, "id", "left").select("node", F.coalesce("pageRank", F.lit(1.0 - damping)).alias("pageRank")))
    kept.clear()
    return found
