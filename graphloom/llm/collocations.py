"""Collocations: phrases whose words come together more often than apart, by Suffix-sigma.

Texts are cut into pieces at punctuation and those into words; phrases don't cross pieces. Each
word begins a suffix, truncated to ``max_n`` words. All of a phrase's occurrences are prefixes of
such suffixes, so it is enough to shuffle suffixes by language and first word: with suffixes
sorted in reverse, one stack of open prefixes counts phrases of every length in one pass. What
comes often has parts that come at least as often, so counts below ``least`` are dropped there and
then, and parts of candidates are joined from what remains.

A task gathers equal suffixes of its texts before it shuffles them, and puts those of a first word
into one row. Words that begin a great share of all suffixes are split by their next word, and pairs of
which the same is true by the word after; what is then counted in several places is summed
afterwards. Which prefixes are that hot is found on a sample of rows; it steers only where rows
go, not what is counted, and a prefix that the sample missed costs time alone.

Sums are of 64 bits, products of 38 decimal digits; a count of more than 10^16 would be an error, not a
wrong score.

Cases: a null text is empty; a null language counts as ``und``, together with a language of that
name. Repeated rows count each time. A very long text is read whole, and takes memory in
proportion. Ties are resolved by count and then the phrase's bytes. An empty table, or one without
a phrase that is frequent enough, gives no rows. Columns other than text and language are not
read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import checkpointed

#: To a line end, which separates pieces, or to a space, which separates words.
TABLE = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")


@dataclass(frozen=True)
class Params:
    """``least`` occurrences of a candidate; ``inside``: percent of them in a longer one that drop it; ``top`` of each language.

    ``chunk``: bytes of text whose suffixes are gathered at once; ``hot``: a prefix is split if its
    share is more than one in so many for each partition; ``sampled``: rows for each partition by
    which hot prefixes are found.
    """

    max_n: int = 3
    least: int = 10
    inside: int = 50
    top: int = 2000
    chunk: int = 6 << 20
    hot: int = 4
    sampled: int = 8


@dataclass
class Layout:
    """Hot prefixes of a language: space-joined words to the number of places that they are split into."""

    places: dict[str, dict[str, int]] = field(default_factory=dict)


def packed(columns: list[np.ndarray]) -> np.ndarray:
    """One number for each row, in the rows' lexicographic order; numbers of columns aren't negative."""
    key, size = columns[0].astype(np.int64), int(columns[0].max(initial=0)) + 1
    for c in columns[1:]:
        n = int(c.max(initial=0)) + 1
        if size * n >= 1 << 62:
            values, key = np.unique(key, return_inverse=True)
            size = len(values)
        key, size = key * n + c, size * n
    return key


def runs(key: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours begins."""
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)


class Words:
    """The words of some texts as codes in byte order from 1, with the words that follow in the piece (0: none)."""

    def __init__(self, texts: list[bytes], max_n: int):
        raw = np.frombuffer(b"\n".join(texts).lower().translate(TABLE), np.uint8)
        line = raw == 10
        gap = line | (raw == 32)
        edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        piece = np.cumsum(line, dtype=np.int32)[start]
        offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
        words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(raw[~gap]))
        encoded = words.dictionary_encode()
        order = pc.sort_indices(encoded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        #: Words by code; that of 0 is empty.
        self.words = pa.concat_arrays([pa.array([""]), encoded.dictionary.take(pa.array(order))])
        first = rank[encoded.indices.to_numpy()] if len(order) else np.empty(0, np.int64)
        self.columns = [first]
        for k in range(1, max_n):
            after = np.zeros(len(first), np.int64)
            there = piece[k:] == piece[:-k]
            after[: len(there)][there] = first[k:][there]
            self.columns.append(after)

    def salts(self, hot: dict[str, int]) -> np.ndarray:
        """Of each suffix 0, or for one with a hot prefix a number by the words after it; the rest of a
        division by 16 is the length of the longest hot prefix."""
        salt = np.zeros(len(self.columns[0]), np.int64)
        if not hot:
            return salt
        crc = np.array([zlib.crc32(w) for w in self.words.cast(pa.binary()).to_pylist()], np.int64)
        names = pa.array(sorted({w for p in hot for w in p.split(" ")}))
        code = {w: i for w, i in zip(names.to_pylist(), pc.index_in(names, self.words).to_pylist(), strict=True) if i is not None}
        at, group = np.arange(len(salt)), np.zeros(len(salt), np.int64)  # suffixes and, of each, its hot prefix so far
        groups = {(): 0}
        for depth, (column, after) in enumerate(zip(self.columns, self.columns[1:], strict=False), 1):
            found = {tuple(p.split(" ")): m for p, m in hot.items() if p.count(" ") == depth - 1}
            known = sorted((groups[p[:-1]] * len(self.words) + code[p[-1]], p, m) for p, m in found.items() if p[:-1] in groups and p[-1] in code)
            if not known:
                break
            keys = np.array([k for k, _, _ in known], np.int64)
            mine = group * len(self.words) + column[at]
            place = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            hit = keys[place] == mine
            at, group = at[hit], place[hit]
            groups = {p: i for i, (_, p, _) in enumerate(known)}
            split = crc[after[at]] % np.array([m for _, _, m in known], np.int64)[group]
            salt[at] = ((salt[at] // 16 * 1_000_003 + split + 1) % (1 << 30)) * 16 + depth
        return salt


def _joined(words: pa.Array, columns: list[np.ndarray]) -> pa.Array:
    """The words of each row, joined by spaces."""
    parts = [words.take(pa.array(c)) for c in columns]
    return pc.binary_join_element_wise(*parts, " ") if len(parts) > 1 else parts[0]


def _by_lang(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language at a time, in chunks of about that size."""
    held, size = {}, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                size += len(text)
            if size >= chunk:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def _gathered(params: Params, layout: Layout):
    """Rows (lang, text) to rows of a first word: what follows it, and how often each (null: once each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _by_lang(batches, params.chunk):
            w = Words(texts, params.max_n)
            salt = w.salts(layout.places.get(lang, {}))
            key = packed([w.columns[0], salt, *w.columns[1:]])
            order = np.argsort(key, kind="stable")
            at = runs(key[order])
            if not len(at):
                continue
            times = np.diff(np.append(at, len(order)))
            rows = order[at]
            first, salt = w.columns[0][rows], salt[rows]
            group = runs(packed([first, salt]))
            ends = pa.array(np.append(group, len(rows)).astype(np.int32))
            listed = lambda values: pc.binary_join(pa.ListArray.from_arrays(ends, values), " ")  # noqa: B023, E731
            single = pa.array(np.maximum.reduceat(times, group) == 1)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(group), pa.string()),
                    w.words.take(pa.array(first[group])),
                    pa.array(salt[group]),
                    listed(_joined(w.words, [c[rows] for c in w.columns[1:]])),
                    pc.if_else(single, pa.scalar(None, pa.string()), listed(pa.array(times).cast(pa.string()))),
                ],
                names=["lang", "word", "salt", "next", "times"],
            )
            yield from (out.slice(i, 4096) for i in range(0, out.num_rows, 4096))

    return run


def _prefixes(t: pa.Table, params: Params) -> Iterator[pa.RecordBatch]:
    """Counts of all prefixes of the suffixes in ``t``, of which rows with the same first word stand together.

    The stack of open prefixes is worked for all suffixes at once: sorted, a prefix is pushed where a
    word up to its length changes, and popped with its sum where that happens next.
    """
    follow = params.max_n - 1
    parts = pc.split_pattern(t.column("next").combine_chunks(), " ")
    entries = pc.list_value_length(parts).to_numpy() // follow
    row = np.repeat(np.arange(len(parts)), entries)
    times = np.ones(len(row), np.int64)
    counted = np.flatnonzero(t.column("times").is_valid().to_numpy())
    if len(counted):
        many = pc.split_pattern(t.column("times").take(pa.array(counted)).combine_chunks(), " ").flatten()
        times[np.isin(row, counted)] = many.cast(pa.int64()).to_numpy()
    words = pa.concat_arrays([pa.array([""]), parts.flatten()]).dictionary_encode()  # so that 0 is no word
    codes = words.indices.to_numpy()[1:].reshape(-1, follow)
    head = ["lang", "word", "salt"]
    group = np.cumsum(_changed(t, head)) - 1
    columns = [group[row], *codes.T]
    order = np.argsort(packed(columns), kind="stable")[::-1]
    row, times = row[order], times[order]
    columns = [c[order] for c in columns]
    depth_known = t.column("salt").to_numpy()[row] % 16  # prefixes up to this length are counted elsewhere as well
    push = np.zeros(len(row), bool)
    for depth, column in enumerate(columns, 1):
        push[runs(column)] = True
        at = np.flatnonzero(push)
        total = np.add.reduceat(times, at) if len(at) else times[:0]
        keep = (total >= params.least) | (depth_known[at] >= depth)
        if depth > 1:
            keep &= column[at] > 0
        at, total = at[keep], total[keep]
        first = t.column("word").take(pa.array(row[at])).combine_chunks()
        rest = [words.dictionary.take(pa.array(c[at])) for c in columns[1:depth]]
        phrase = pc.binary_join_element_wise(first, *rest, " ") if rest else first
        yield _counts(t.column("lang").take(pa.array(row[at])).combine_chunks(), phrase, depth, total)
    langs = t.column("lang").combine_chunks().dictionary_encode()
    sums = np.bincount(langs.indices.to_numpy()[row], times, len(langs.dictionary)).astype(np.int64)
    yield _counts(langs.dictionary, pa.nulls(len(sums), pa.string()), 0, sums)


def _counts(lang: pa.Array, phrase: pa.Array, words: int, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(f), words, np.int32)), pa.array(f)], names=["lang", "phrase", "words", "f"])


def _changed(t: pa.Table, names: list[str]) -> np.ndarray:
    """Whether each row differs from that before in any of these columns."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in names:
        column = t.column(c).combine_chunks()
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return new


def _counted(params: Params):
    """Sorted rows of first words to counts of phrases; the last word's rows wait for those of the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("next").nbytes
            if size >= params.chunk:
                t = pa.Table.from_batches(held)
                last = np.flatnonzero(_changed(t, ["lang", "word", "salt"]))[-1]
                if last:
                    yield from _prefixes(t.slice(0, last), params)
                held = t.slice(last).to_batches()
                size = 0
        if held:
            yield from _prefixes(pa.Table.from_batches(held), params)

    return run


def _sampled(params: Params):
    """Rows (lang, text) to counts of prefixes shorter than a suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _by_lang(batches, params.chunk):
            w = Words(texts, params.max_n)
            for depth in range(1, params.max_n):
                there = w.columns[depth - 1] > 0
                columns = [c[there] for c in w.columns[:depth]]
                key = packed(columns)
                order = np.argsort(key, kind="stable")
                at = runs(key[order])
                f = np.diff(np.append(at, len(order)))
                often = f > 1  # what comes once in a chunk isn't hot
                phrase = _joined(w.words, [c[order[at[often]]] for c in columns])
                yield _counts(pa.array([lang] * len(phrase), pa.string()), phrase, depth, f[often])
            yield _counts(pa.array([lang]), pa.nulls(1, pa.string()), 0, np.array([len(w.columns[0])]))

    return run


COUNTS = "lang string, phrase string, words int, f long"


def layout(rows: DataFrame, params: Params) -> Layout:
    """Prefixes whose share of a sample's suffixes is too great for one of the session's partitions.

    There are at most ``hot`` times ``max_n - 1`` for each partition, so the list's size follows that number.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = rows.count()
    sample = rows.sample(min(1.0, params.sampled * max(partitions, 125) / max(n, 1)), seed=1)
    counts = checkpointed(sample.mapInArrow(_sampled(params), COUNTS).groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")))
    total = counts.where("words = 0").agg(F.sum("f")).first()[0] or 0
    out = Layout()
    for r in counts.where((F.col("words") > 0) & (F.col("f") * params.hot * partitions > total)).collect():
        out.places.setdefault(r["lang"], {})[r["phrase"]] = 1 + r["f"] * params.hot * partitions // total
    return out


def frequent_phrases(docs: DataFrame, params: Params = Params(), text: str = "text", lang: str = "lang") -> DataFrame:
    """Columns lang, phrase, words, f: phrases of up to ``max_n`` words with at least ``least`` occurrences;
    with a null phrase and 0 words, all of a language's words."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    gathered = rows.mapInArrow(_gathered(params, layout(rows, params)), "lang string, word string, salt long, next string, times string")
    key = ["word", "lang", "salt"]
    counts = gathered.repartition(*key).sortWithinPartitions(*[F.desc(c) for c in key]).mapInArrow(_counted(params), COUNTS)
    counts = counts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    return checkpointed(counts.where((F.col("f") >= params.least) | F.col("phrase").isNull()))


def _part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(phrases: DataFrame, params: Params = Params()) -> DataFrame:
    """Columns lang, phrase, a, l, r, score of all candidates: by the cut with the lowest score."""
    whole = F.col("words") - 1
    cuts = phrases.where("words >= 2").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), whole)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("w"), F.lit(1), F.col("k")).alias("left"), _part(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(phrases.where("words >= 1").select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    top = (wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")
    cuts = cuts.withColumn("top", top).withColumn("base", (wide("l") * wide("r")).cast("decimal(38,0)"))
    best = cuts.withColumn("score", F.expr("top div base")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    return best.select("lang", "phrase", "a", "s.l", "s.r", "s.score")


def _covered(phrases: DataFrame) -> DataFrame:
    """Columns lang, phrase, longer: of each phrase the most occurrences of a longer one around it."""
    longer = phrases.where("words >= 3").select("lang", F.col("f").alias("longer"), F.split("phrase", " ").alias("w"))
    longer = longer.select("*", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("n"))
    longer = longer.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("i"))
    return longer.groupBy("lang", _part(F.col("w"), F.col("i"), F.col("n")).alias("phrase")).agg(F.max("longer").alias("longer"))


def collocations(docs: DataFrame, params: Params = Params(), text: str = "text", lang: str = "lang") -> DataFrame:
    """Columns lang, rank, phrase, a, l, r, n, score: each language's best phrases.

    ``a``, ``l``, ``r``: occurrences of the phrase and its two parts, ``n``: of all words. Ranks
    are found in groups of a language's phrases first, then among those groups' best.
    """
    phrases = frequent_phrases(docs, params, text, lang)
    found = scored(phrases, params).join(_covered(phrases), ["lang", "phrase"], "left")
    found = found.where(F.col("longer").isNull() | (100 * F.col("longer") < params.inside * F.col("a"))).drop("longer")
    found = found.withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(64)).cast("int"))
    for _ in range(3):
        order = Window.partitionBy("lang", "group").orderBy(F.desc("score"), F.desc("a"), "phrase")
        found = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= params.top)
        found = found.withColumn("group", F.floor(F.col("group") / 8).cast("int"))
    totals = phrases.where("words = 0").select("lang", F.col("f").alias("n"))
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
