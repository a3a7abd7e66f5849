"""The most alike of all known names for each asked one, by Dice's coefficient of their bigrams.

Pairs that are alike grow with the square of the names where names are made of the same words, so they aren't listed: in steps
of a falling threshold all pairs above it are found, and who has one is done, as nothing below can be nearer. A step is a set
similarity join. Bigrams that no name of the other side has are left out; a pair must have enough of the others in common, by the sizes of
both; so it also has some of the rarest in common, and the pairs meet at each choice of several of these. The next
threshold and how many bigrams are chosen follow from the sizes of names and from what some names have in common; that steers the
work and changes no result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.checkpoints import Rounds, cut

#: Bigrams are counted by hashes of so many bits: what tasks and the driver hold of them.
BITS = 16
#: Steps from 1 to the threshold; rows and pairs of a step, about, below which lower thresholds are tried first.
STEPS, WORK = 10, 20_000_000
#: Bigrams that are chosen at most, and names that are compared to estimate how many are alike.
CHOSEN, ASKED, KNOWN = 5, 400, 4000
#: Keys that a task makes at a time, about.
HELD = 1 << 20
TOKENS = pa.schema([("id", pa.int64()), ("g", pa.list_(pa.int64()))])
KEYS = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])


def _hashed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _bucket(token: np.ndarray) -> np.ndarray:
    return (_hashed(token) >> np.uint64(64 - BITS)).astype(np.int64)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct bigrams of each text that isn't empty, as numbers; a text of one letter is its own."""
    for batch in batches:
        texts = batch.column("low").to_pylist()
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(texts)), size)
        last = np.cumsum(size) - 1
        token = letters << 21 | np.append(letters[1:], 0)
        token[last] = letters[last] << 21 | 0x1FFFFF
        kept = np.full(len(token), True)
        kept[last[size > 1]] = False
        row, token = row[kept], token[kept]
        order = np.lexsort((token, row))
        row, token = row[order], token[order]
        new = np.append(True, (row[1:] != row[:-1]) | (token[1:] != token[:-1]))[: len(row)]
        ends = np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=len(texts)))))
        g = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(token[new]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), g], schema=TOKENS)


def _told(names: DataFrame, rounds: Rounds) -> DataFrame:
    """``names`` (distinct, in ``name``) with an ``id`` and their bigrams ``g``."""
    rows = rounds.written(names.withColumn("id", F.monotonically_increasing_id()))
    found = rows.select("id", F.lower("name").alias("low")).mapInArrow(_tokens, "id long, g array<long>")
    return rounds.written(rows.join(found.hint("merge"), "id"))


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each bigram's row, the bigrams, and their number by row."""
    g = batch.column("g")
    size = np.diff(g.offsets.to_numpy()).astype(np.int64)
    return np.repeat(np.arange(len(size)), size), g.flatten().to_numpy(), size


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, n = np.unique(_bucket(_rows(batch)[1]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["at", "n"])


def _counts(names: DataFrame) -> np.ndarray:
    """How many of ``names`` have bigrams of each hash."""
    out = np.zeros(1 << BITS, np.int64)
    for r in names.select("g").mapInArrow(_counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def _sizes(names: DataFrame, other: np.ndarray) -> np.ndarray:
    """Numbers of bigrams, of those that the other side may have, and of such names."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, token, n = _rows(batch)
            a = np.bincount(row[other[_bucket(token)] > 0], minlength=len(n))
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(a)], names=["n", "a"])

    found = names.select("g").mapInArrow(sizes, "n long, a long").groupBy("n", "a").agg(F.count("*").alias("c")).collect()
    return np.array([(r["n"], r["a"], r["c"]) for r in found], np.int64).reshape(-1, 3)


def common(n, m, t: float):
    """Bigrams that names of ``n`` and ``m`` must have in common."""
    return np.ceil((n + m) * t / 2 - 1e-9).astype(np.int64)


class Step:
    """What a step at threshold ``t`` asks of names, by their sizes, if ``chosen`` bigrams are chosen.

    ``need``: by the size of a known name, the least that any asked one must have in common with it; ``chosen``: of which so many
    are chosen. ``keys``: what both sides then make.
    """

    def __init__(self, asked: np.ndarray, known: np.ndarray, t: float, chosen: int) -> None:
        self.t = t
        self.sizes = np.unique(known[:, 0])
        self.most = np.array([known[known[:, 0] == m, 1].max() for m in self.sizes], np.int64)
        c = common(asked[:, :1], self.sizes[None, :], t)
        self.never = int(c.max(initial=0)) + 1
        reach = (c <= asked[:, 1:2]) & (c <= self.most[None, :])
        self.need = np.where(reach, c, self.never).min(axis=0) if len(asked) else np.full(len(self.sizes), self.never)
        self.chosen = np.minimum(chosen, self.need)
        self.place = {int(m): i for i, m in enumerate(self.sizes)}
        at = np.searchsorted(self.sizes, known[:, 0])
        kept = known[:, 1] >= self.need[at]
        ways = np.frompyfunc(math.comb, 2, 1)
        self.names = int(known[kept, 2].sum())
        self.right = float((known[kept, 2] * ways(known[kept, 1] - self.need[at[kept]] + self.chosen[at[kept]], self.chosen[at[kept]])).sum())
        left = np.where(reach, ways(np.where(reach, asked[:, 1:2] - c, 0) + self.chosen[None, :], self.chosen[None, :]), 0)
        self.left = float((asked[:, 2:3] * left).sum())

    def cost(self, share: float, alike: float) -> float:
        """Rows, and a part of the pairs to look at, if a bigram is in that ``share`` of names, and pairs that are ``alike``."""
        least = int(self.chosen[self.need < self.never].min(initial=CHOSEN))
        return self.left + self.right + 0.05 * self.left * self.names * share**least + 3 * alike

    def asked(self, n: int, a: int) -> list[tuple[int, int, int]]:
        """Sizes of known names with how many of the rarest bigrams are chosen from, and how many."""
        c = common(n, self.sizes, self.t)
        fit = (c <= a) & (c <= self.most) & (self.need < self.never)
        return [(int(m), int(a - k + x), int(x)) for m, k, x in zip(self.sizes[fit], c[fit], self.chosen[fit], strict=True)]

    def known(self, n: int, a: int) -> list[tuple[int, int, int]]:
        i = self.place[n]
        return [(n, int(a - self.need[i] + self.chosen[i]), int(self.chosen[i]))] if self.need[i] <= a else []


def _keys(names: DataFrame, other: np.ndarray, order: np.ndarray, choices: Callable[[int, int], list[tuple[int, int, int]]]) -> DataFrame:
    """A row for each choice of bigrams at which names meet; ``low`` and ``high``: bits that their bigrams set."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            row, token, n = _rows(batch)
            ids, begin = batch.column("id").to_numpy(), np.cumsum(n) - n
            bit = _hashed(token) & np.uint64(127)
            one = np.left_shift(np.uint64(1), bit & np.uint64(63))
            low, high = (np.bitwise_or.reduceat(np.where(side, one, np.uint64(0)), begin).view(np.int64) for side in (bit < 64, bit >= 64))
            bucket = _bucket(token)
            may = other[bucket] > 0
            row, token, df = row[may], token[may], order[bucket[may]]
            rank = np.lexsort((token, df, row))
            token, a = token[rank], np.bincount(row, minlength=len(n))
            begin = np.cumsum(a) - a
            for size, of in {(int(x), int(y)) for x, y in zip(n, a, strict=True)}:
                own = np.flatnonzero((n == size) & (a == of))
                for m, prefix, chosen in choices(size, of):
                    ways = np.array(list(combinations(range(prefix), chosen)), np.int64)
                    step = max(1, HELD // len(ways))
                    for i in range(0, len(own), step):
                        some = own[i : i + step]
                        key = np.full((len(some), len(ways)), m, np.uint64)
                        for j in range(chosen):
                            key = _hashed(key * np.uint64(31) ^ token[begin[some][:, None] + ways[:, j][None, :]].astype(np.uint64))
                        wide = lambda x, some=some, ways=ways: pa.array(np.repeat(x[some], len(ways)))
                        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), wide(ids), wide(n.astype(np.int32)), wide(low), wide(high)], schema=KEYS)

    return names.select("id", "g").mapInArrow(keys, "key long, id long, n int, low long, high long")


def _some(names: DataFrame, count: int) -> list[list[int]]:
    return [r["g"] for r in names.select("id", "g").orderBy(F.xxhash64("id"), "id").limit(count).collect()]


def _scores(asked: list[list[int]], known: list[list[int]]) -> np.ndarray:
    """Of all pairs of some names."""
    all_ = np.unique(np.concatenate([np.zeros(0, np.int64), *map(np.array, asked), *map(np.array, known)]))
    x, y = (np.zeros((len(side), len(all_)), np.float32) for side in (asked, known))
    for side, into in ((asked, x), (known, y)):
        for i, g in enumerate(side):
            into[i, np.searchsorted(all_, g)] = 1
    return 2 * (x @ y.T) / (x.sum(axis=1)[:, None] + y.sum(axis=1)[None, :])


def _next(asked: np.ndarray, known: np.ndarray, share: float, scores: np.ndarray, steps: list[float]) -> Step | None:
    """The step of the lowest threshold that isn't too much work, else of the highest at which anything can be found."""
    pairs, last = float(asked[:, 2].sum()) * float(known[:, 2].sum()) / max(1, scores.size), None
    for t in reversed(steps):
        alike = pairs * float((scores >= t - 1e-6).sum())
        cost, _, step = min((s.cost(share, alike), k, s) for k in range(1, CHOSEN + 1) for s in [Step(asked, known, t, k)])
        if not step.names:
            break
        last = step
        if cost <= WORK:
            break
    return last


def _alike(left: DataFrame, right: DataFrame, step: Step, sides: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``l``, ``r``: pairs that may be alike, by the bits that one sets and the other doesn't."""
    of_left, of_right = sides
    x = _keys(left, of_right, of_right, step.asked).select(F.col("key").alias("x"), F.col("id").alias("l"), F.col("n").alias("n"), F.col("low").alias("xl"), F.col("high").alias("xh"))
    y = _keys(right, of_left, of_right, step.known).select(F.col("key").alias("y"), F.col("id").alias("r"), F.col("n").alias("m"), F.col("low").alias("yl"), F.col("high").alias("yh"))
    apart = F.bit_count(F.col("xl").bitwiseXOR(F.col("yl"))) + F.bit_count(F.col("xh").bitwiseXOR(F.col("yh")))
    total = F.col("n") + F.col("m")
    return x.join(y.hint("merge"), (F.col("x") == F.col("y")) & (apart <= total - 2 * F.ceil(total * step.t / 2 - 1e-9))).select("l", "r").distinct()


def nearest(asked: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """``service``, ``name``, ``score``, ``id``: of each asked (service, name) the most alike known one (repo, name, id), ties to the least id.

    The coefficient is ``threshold`` at least. A service takes names of its repository only; a null one takes all.
    """
    spark = asked.sparkSession
    rounds, once, results = Rounds(spark, "left"), Rounds(spark, "names", keep=None), []
    least = known.where(F.length("name") > 0).groupBy("name", "repo").agg(F.min("id").alias("symbol")).groupBy("name").agg(F.collect_list(F.struct("repo", "symbol")).alias("owners"))
    right = _told(least, once)
    left = _told(asked.where(F.length("name") > 0).select("name", "service").distinct().groupBy("name").agg(F.collect_list(F.struct("service")).alias("services")), once)
    of_right, known_some = _counts(right), _some(right, KNOWN)
    steps = [1 - (1 - threshold) * k / STEPS for k in range(STEPS + 1)]
    while steps:
        of_left = _counts(left)
        sizes = _sizes(left, of_right), _sizes(right, of_left)
        if not len(sizes[0]) or not len(sizes[1]):
            break
        share = float((of_left * of_right).sum()) / max(1, int(of_left[of_right > 0].sum())) / int(sizes[1][:, 2].sum())
        step = _next(*sizes, share, _scores(_some(left, ASKED), known_some), steps)
        if step is None:
            break
        pairs = _alike(left, right, step, (of_left, of_right))
        both = pairs.join(left.select(F.col("id").alias("l"), "name", "services", "g").hint("merge"), "l").join(right.select(F.col("id").alias("r"), "owners", F.col("g").alias("h")).hint("merge"), "r")
        score = 2.0 * F.size(F.array_intersect("g", "h")) / (F.size("g") + F.size("h"))
        both = both.withColumn("score", score).where(F.col("score") >= step.t - 1e-9)
        each = both.select("l", "name", "score", "owners", F.inline("services")).select("l", "name", "score", "service", F.inline("owners")).where("service IS NULL OR service = repo")
        best: Column = F.min_by("symbol", F.struct(-F.col("score"), "symbol"))
        results.append(cut(each.groupBy("l", "name", "service").agg(F.max("score").alias("score"), best.alias("id"))))
        steps = [t for t in steps if t < step.t]
        if steps:
            done = results[-1].groupBy(F.col("l").alias("id")).agg(F.collect_list(F.struct("service")).alias("done"))
            rest = left.join(done.hint("merge"), "id", "left").withColumn("services", F.when(F.col("done").isNull(), F.col("services")).otherwise(F.array_except("services", "done")))
            left = rounds.written(rest.where(F.size("services") > 0).drop("done"))
    rounds.clear()
    once.clear()
    if not results:
        return asked.select("service", "name", F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("id")).where("false")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.select("service", "name", "score", "id")
