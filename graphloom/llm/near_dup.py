"""MinHash near-duplicates: one-permutation hashing, bands, star-shaped candidate edges.

A document's set holds the hashes of its distinct word shingles. One hash of each shingle gives
both its bin and its rank there (one-permutation hashing); a bin without a shingle takes the
value of another, probed in an order that is the same for all documents (optimal
densification). Documents with the same set are one class, of which only the first goes on, so
copies are never paired. A band of bins is a bucket key.

Candidates of a bucket are not all its pairs, but a star: its centre is the member that shares
most buckets with others, each spoke is confirmed on the full sets, and links make components.
What stars can miss is a link between two texts of a bucket that are in different components
then. Those pairs follow in one more step, made only where both texts have a rare shingle in
common (an exact prefix filter), so that no bucket is expanded into its pairs. Thus any two
texts of a bucket are linked if similar enough, or compared, or can't be similar enough.

At a similarity of 0.85 a pair shares none of the 42 bands of six with a chance of about 2e-9,
at 0.8 of 3e-6.

Keys with a great share of all rows, buckets and shingles alike, are never dealt by the key alone:
what is known of a hot key is broadcast to its rows, and the comparisons of a shingle are split.

Cases: a text with fewer words than a shingle is one shingle; a null text or one without words
has an empty set and is linked with nothing. Rows with the same id and text are alike in all;
if rows of one id have several texts each row is judged by its own. Of equally weighted centres
the smallest id is taken. A very long text is read whole and needs memory in proportion. A null id is never the
smallest; such a row gets the component of its text, or null. An empty table gives no rows.
Other columns of the input are not read,
whatever their names; ``representatives`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import checkpointed, free_prefix
from graphloom.llm.components import components


@dataclass(frozen=True)
class Params:
    """``percent``: least similarity; ``filter_bits``: size of the filter of ids, a power of 2."""

    words: int = 5
    percent: int = 80
    bands: int = 42
    rows: int = 6
    filter_bits: int = 25
    cached_words: int = 400_000


MASK = (1 << 64) - 1


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, params: Params):
        self.n, self.most, self.cache = params.words, params.cached_words, {}
        self.places = _mixed(np.arange(1, params.words + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def shingles(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []  # of bytes: A-Z, and ASCII white space
        if not words:
            return np.empty(0, np.uint64)
        cache = self.cache
        try:
            w = np.array([cache[x] for x in words], np.uint64)
        except KeyError:
            if len(cache) > self.most:
                cache.clear()
            cache.update((x, xxhash.xxh3_64_intdigest(x)) for x in set(words))
            w = np.array([cache[x] for x in words], np.uint64)
        n = min(self.n, len(w))
        h = np.full(len(w) - n + 1, n, np.uint64) * self.places[-1]
        for i in range(n):
            h += w[i : len(w) - n + 1 + i] * self.places[i]
        return np.unique(_mixed(h))


class Bands:
    """Bucket keys of a set of hashes."""

    def __init__(self, params: Params):
        self.shape, self.k = (params.bands, params.rows), params.bands * params.rows
        self.probes = np.random.default_rng(7).integers(0, self.k, (self.k, 4096))

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """Of each bin its least hash; ``hashes`` ascend and are not empty."""
        bins = ((hashes >> np.uint64(32)) * np.uint64(self.k)) >> np.uint64(32)  # ascend as well
        first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
        full = np.zeros(self.k, bool)
        out = np.zeros(self.k, np.uint64)
        at = bins[first].astype(np.int64)
        full[at], out[at] = True, hashes[first]
        rest = np.flatnonzero(~full)
        for lo, hi in ((0, 16), (16, 256), (256, 4096)):
            if not len(rest):
                return out
            hits = full[self.probes[rest, lo:hi]]
            some = hits.any(axis=1)
            got = rest[some]
            out[got] = out[self.probes[got, lo + hits[some].argmax(axis=1)]]
            rest = rest[~some]
        out[rest] = out[at[0]]
        return out

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        sig = self.signature(hashes).reshape(self.shape)
        key = np.arange(1, self.shape[0] + 1, dtype=np.uint64)
        for i in range(self.shape[1]):
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) ^ sig[:, i])
        return key.view(np.int64)


def _sign_partition(params: Params):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bands = Shingler(params), Bands(params)
        for batch in batches:
            sizes, high, low, keys, ends = [], [], [], [], [0]
            for text in batch.column(1).to_pylist():
                hashes = shingler.shingles(text)
                digest = xxhash.xxh3_128_intdigest(hashes.tobytes())
                sizes.append(len(hashes))
                high.append((digest >> 64) - (1 << 63))
                low.append((digest & MASK) - (1 << 63))
                if len(hashes):
                    keys.append(bands.keys(hashes))
                ends.append(params.bands * len(keys))
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                names=["doc_id", "n_shingles", "high", "low", "keys"],
            )

    return sign


def _sets_partition(params: Params, wanted):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bits = Shingler(params), wanted.value
        for batch in batches:
            slot = batch.column(2).to_numpy()
            at = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
            rows = [shingler.shingles(x) for x in batch.column(1).take(pa.array(at)).to_pylist()]
            flat = np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "hashes"])

    return sets


def _sets(rows: DataFrame, nodes: DataFrame, params: Params) -> DataFrame:
    """Columns ``node``, ``hashes`` for the documents in ``nodes``.

    A filter of fixed size over hashed ids leaves out most other documents before their text
    is read again; the semi join leaves out the rest.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << params.filter_bits))
    taken = nodes.select(slot("node").alias("s")).groupBy(F.shiftright("s", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 31 as int))")).alias("bits")).toPandas()
    words = np.zeros(1 << (params.filter_bits - 5), np.uint32)
    words[taken["at"].to_numpy(np.int64)] = taken["bits"].to_numpy(np.int64).astype(np.uint32)
    wanted = rows.sparkSession.sparkContext.broadcast(words.view(np.uint8))
    found = rows.where("doc_id IS NOT NULL").select("doc_id", "text", slot("doc_id").alias("slot")).mapInArrow(_sets_partition(params, wanted), "node long, hashes array<long>")
    return found.join(nodes, "node", "left_semi").groupBy("node", F.xxhash64("hashes").alias("x")).agg(F.first("hashes").alias("hashes")).drop("x")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough."""
    one = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a"))
    other = sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    least = 100 * both >= percent * (F.size("a") + F.size("b") - both)
    return pairs.join(other, "v").join(one, "u").where(least).select("u", "v").distinct()


def near_duplicates(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    signed = checkpointed(rows.mapInArrow(_sign_partition(params), "doc_id long, n_shingles long, high long, low long, keys array<long>"))
    same = ("n_shingles", "high", "low")
    classes = checkpointed(signed.where("n_shingles > 0").groupBy(*same).agg(F.min(F.struct("doc_id", "keys")).alias("r"), F.min("doc_id").alias("node")).withColumn("keys", F.col("r.keys")).drop("r"))
    labels = _labels(rows, classes.where("node IS NOT NULL"), params)
    # a component's smallest id is that of its smallest class
    of_class = classes.select(*same, "node").join(labels, "node", "left").select(*same, F.coalesce("label", "node").alias("component_id"))
    out = signed.select("doc_id", *same).join(of_class, list(same), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: A key with at least this share of all rows is hot; there are no more hot keys than its inverse.
HOT = 1000


def _with_facts(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` joined with ``facts``, one row a key, whose ``count`` is the number of the key's rows.

    Rows of hot keys aren't dealt by the key, which would send them to one task: the facts of hot
    keys, at most ``HOT`` by arithmetic, are broadcast to them.
    """
    total = rows.count()
    is_hot = F.col(count) * HOT >= total
    hot = facts.where(is_hot)
    keys = [r[0] for r in hot.select(key).collect()]
    if not keys:
        return rows.join(facts, key)
    cold = rows.where(~F.col(key).isin(keys)).join(facts.where(~is_hot), key)
    return rows.where(F.col(key).isin(keys)).join(F.broadcast(hot), key).unionByName(cold)


def _open(rows: DataFrame, key: str) -> DataFrame:
    """Rows of the keys that have several labels, with the key's number of rows (``size``) and commonest label (``main``)."""
    by_label = rows.groupBy(key, "label").agg(F.count("*").alias("c"))
    facts = by_label.groupBy(key).agg(F.sum("c").alias("size"), F.count("*").alias("labels"), F.max(F.struct("c", "label"))["label"].alias("main"))
    return _with_facts(rows, checkpointed(facts.where("labels > 1").drop("labels")), key, "size")


def _like_sized(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= percent * F.greatest(a, b)


def _stars(members: DataFrame, percent: int) -> DataFrame:
    """A pair of each member of a bucket with the bucket's centre."""
    first = F.min(F.struct((-F.col("weight")).alias("w"), "node", "n"))
    hubs = checkpointed(members.groupBy("key").agg(first.alias("h"), F.count("*").alias("size")).select("key", "size", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n")))
    pairs = _with_facts(members, hubs, "key", "size").where((F.col("node") != F.col("hub")) & _like_sized("n", "hub_n", percent))
    return pairs.select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()


#: Rows of a shingle that are compared in one task.
SPLIT = 512


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of different components that share a bucket and could be similar enough.

    With all shingles in one order, rarest first, two sets of that similarity share one in their
    first ``n - ceil(percent * n / 100) + 1``. So pairs are made from shared rare shingles only,
    and of those of a shingle none inside its commonest component.
    """
    nodes = members.groupBy("node").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.collect_set("key").alias("keys"))
    each = sets.join(nodes, "node", "left_semi").select("node", F.size("hashes").alias("n"), F.explode("hashes").alias("hash"))
    common = checkpointed(each.groupBy("hash").agg(F.count("*").alias("df")))
    rarest = Window.partitionBy("node").orderBy("df", "hash")
    first = _with_facts(each, common, "hash", "df").withColumn("at", F.row_number().over(rarest)).where(F.expr(f"df > 1 AND at <= n - (n * {percent} + 99) div 100 + 1"))
    rows = checkpointed(_open(checkpointed(first.select("node", "hash", "at").join(nodes, "node")), "hash"))
    # of a shingle with many rows a task gets some of them, and all those outside its main component
    parts = F.ceil(F.col("size") / SPLIT).cast("int")
    outside = rows.where("label <> main").withColumn("split", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.withColumn("split", F.pmod(F.xxhash64("node"), parts).cast("int"))
    outside = outside.select("hash", "split", F.col("node").alias("a"), F.col("n").alias("an"), F.col("label").alias("al"), F.col("keys").alias("ak"), F.col("at").alias("place"))
    # if this is the first that both have, what follows it must hold the rest of what they share
    needed = F.expr(f"({percent} * (n + an) + {99 + percent}) div {100 + percent}")
    enough = F.least(F.col("n") - F.col("at"), F.col("an") - F.col("place")) + 1 >= needed
    pairs = outside.join(rows, ["hash", "split"]).where((F.col("label") != F.col("al")) & _like_sized("n", "an", percent) & enough & F.arrays_overlap("keys", "ak"))
    return pairs.select(F.least("node", "a").alias("u"), F.greatest("node", "a").alias("v")).distinct()


def _labels(rows: DataFrame, classes: DataFrame, params: Params) -> DataFrame:
    """Columns ``node``, ``label`` for the classes that are linked to another."""
    entries = classes.select(F.explode("keys").alias("key"), "node", F.col("n_shingles").alias("n"))
    shared = checkpointed(entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    members = _with_facts(entries, shared, "key", "size")
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    members = checkpointed(members.select("key", "node", "n").join(weight, "node"))
    sets = checkpointed(_sets(rows, members.select("node").distinct(), params))
    stars = checkpointed(_stars(members, params.percent))
    links = checkpointed(_confirmed(stars, sets, params.percent))
    labels = components(links)
    members = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    members = checkpointed(_open(checkpointed(members), "key").select("key", "node", "n", "label"))
    pairs = _across(members, sets, params.percent).join(stars, ["u", "v"], "left_anti")
    more = checkpointed(_confirmed(checkpointed(pairs), sets, params.percent))
    return labels if more.isEmpty() else components(links.unionByName(more))


def representatives(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that are near-duplicates of one with a smaller id.

    Rows that repeat an id and text stay once; rows without an id stay.
    """
    found = near_duplicates(docs, params, id_col, text_col)
    name = free_prefix(docs) + "kept"
    kept = found.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(name)).distinct()
    named = docs.join(kept, F.col(id_col) == F.col(name), "left_semi").dropDuplicates([id_col, text_col])
    return named.unionByName(docs.where(F.col(id_col).isNull()))
