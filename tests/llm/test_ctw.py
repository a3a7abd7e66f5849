"""Context-tree weighting against a recursive version, and the word baseline by counting."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import ctw
from graphloom.llm.common import is_remainder, remainder

DEPTH = 2


def kt(zeros, ones):
    """log2 of the KT probability, one symbol after the other."""
    out = 0.0
    for k in range(zeros):
        out += math.log2((k + 0.5) / (k + 1))
    for k in range(ones):
        out += math.log2((k + 0.5) / (zeros + k + 1))
    return out


class Brute:
    """Weights all contexts of up to ``DEPTH`` bytes that stand in the training texts."""

    def __init__(self, texts):
        self.counts = Counter()
        for t in texts:
            data = ctw.END * DEPTH + ctw.stream(ctw.normal_words(t.encode()))
            for i in range(DEPTH, len(data)):
                for d in range(DEPTH + 1):
                    for level in range(8):
                        self.counts[data[i - d : i], level, data[i] >> (8 - level), (data[i] >> (7 - level)) & 1] += 1
        self.contexts = {c for c, *_ in self.counts}

    def n(self, context, level, prefix):
        return [self.counts[context, level, prefix, bit] for bit in (0, 1)]

    def weighted(self, context, level, prefix):
        own = kt(*self.n(context, level, prefix))
        if len(context) == DEPTH:
            return own
        below = sum(self.weighted(bytes([b]) + context, level, prefix) for b in range(256) if bytes([b]) + context in self.contexts)
        return math.log2(0.5 * 2**own + 0.5 * 2**below)

    def p_one(self, past, level, prefix):
        def go(context):
            zeros, ones = self.n(context, level, prefix)
            own = (ones + 0.5) / (zeros + ones + 1)
            if len(context) == DEPTH:
                return own
            longer = past[len(past) - len(context) - 1 :]
            share = 2 ** (kt(zeros, ones) - 1 - self.weighted(context, level, prefix))
            # a context that training has not seen has a fresh estimate
            return share * own + (1 - share) * (go(longer) if longer in self.contexts else 0.5)

        return go(b"")

    def log10(self, text):
        data, out = ctw.END * DEPTH + ctw.stream(ctw.normal_words(text.encode())), 0.0
        for i in range(DEPTH, len(data)):
            for level in range(8):
                p = self.p_one(data[i - DEPTH : i], level, data[i] >> (8 - level))
                out += math.log10(p if (data[i] >> (7 - level)) & 1 else 1 - p)
        return out


TRAIN = ["the cat sat", "The cat ran", "a dog ran", "a cat"]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(t,) for t in TRAIN], "text string")
    return ctw.fit(docs, ctw.Params(depth=DEPTH))


def test_scores_are_those_of_the_recursion(spark, model):
    texts = ["the cat ran", "a zebra", "", "dog dog"]
    brute = Brute(TRAIN)
    got = {r["doc_id"]: r["score"] for r in ctw.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(brute.log10(t), rel=1e-4, abs=1e-4)


def test_bytes_have_probabilities_that_sum_to_one(model):
    assert (10.0 ** model.tree.logs).sum(axis=1) == pytest.approx(1, abs=1e-4)


def words_of(text):
    """The words of a text by the pattern, and its end."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def expected_base(rows, train):
    count = Counter(w for t in train for w in words_of(t))
    total = sum(count.values())
    out = {}
    for i, t in rows:
        words = words_of(t)
        out[i] = len(words), sum(w in count for w in words), total, sum(math.log10((count[w] + 1) / (total + 1 * (len(count) + 1))) for w in words)
    return out


@pytest.mark.parametrize("frequent", [1 << 20, 5])
def test_base_on_documents(spark, frequent):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.withColumn("train", F.coalesce(remainder("doc_id", 7) != 2, F.lit(False))).collect()
    want = expected_base([(r["doc_id"], r["text"]) for r in rows], [r["text"] for r in rows if r["train"]])
    params = ctw.Params(frequent=frequent)
    model = ctw.fit(docs.where(remainder("doc_id", 7) != 2), params)
    got = ctw.score(docs, model, held_out=is_remainder("doc_id", 7, 2)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)


def test_contexts_tell_more_of_held_out_texts_than_words(spark):
    # with 10,000 documents; with 1,000 both tell about as much, with fewer words tell more
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    model = ctw.fit(docs.where(remainder("doc_id", 7) != 2))
    held = ctw.score(docs.where(remainder("doc_id", 7) == 2), model).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.avg((F.col("score") > F.col("base_score")).cast("int")).alias("better")).first()
    assert held["s"] > held["b"] and held["better"] > 0.9


def test_nulls_empties_repeats_and_no_training(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a b", "z"), (3, "a b", "z"), (None, "a", "w")], "doc_id long, text string, score string")
    model = ctw.fit(docs.where("false"))
    got = sorted(((r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["bits_per_byte"], 3)) for r in ctw.score(docs, model).collect()))
    assert got == [(0, 2, 0, 8.0), (1, 1, 0, 8.0), (2, 1, 0, 8.0), (3, 3, 0, 8.0), (3, 3, 0, 8.0)]
    assert ctw.score(docs.where("false"), model).count() == 0


def test_rare_contexts_are_learned_at_any_size(spark):
    # the contexts of "qxz vwk" are a far smaller share of the bytes than a share that cuts keeps
    train = [*["the cat ran and the dog sat"] * 50, "qxz vwk"]
    params = ctw.Params(depth=DEPTH, chunk=16, packed=20)
    texts = ["qxz vwk", "the cat", "unseen 日本", "", None]
    got = {r["doc_id"]: r["score"] for r in ctw.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ctw.fit(spark.createDataFrame([(t,) for t in train], "text string"), params)).collect()}
    brute = Brute(train)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(brute.log10(t or ""), rel=1e-4, abs=1e-4)


def test_streams_of_many_texts_are_those_of_each():
    texts = ["", None, " \t", "The  cat\x0b\x0c SAT \n", "\x00\x1f a\x85b\x0d\x0aÀÉ 日本", "x" * 50, " y"]
    raw = [None if t is None else t.encode() for t in texts]
    data, lengths, keys = ctw._streams(raw, DEPTH)
    want = [ctw.stream(ctw.normal_words(t)) for t in raw]
    assert data.tobytes() == b"".join(want) and lengths.tolist() == [len(x) for x in want]
    padded = [ctw.END * DEPTH + x for x in want]
    assert keys.tolist() == [int.from_bytes(x[i - DEPTH : i + 1], "big") for x in padded for i in range(DEPTH, len(x))]
    words, n = ctw._words(data)
    assert n.tolist() == [len(words_of(t)) for t in texts]
    assert words.to_pylist() == [w.encode() + b" " if w is not None else ctw.END for t in texts for w in words_of(t)]


def test_places_by_key_have_all_keys_of_clashing_hashes():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 40, 500)
    order, heads, n = ctw._runs(keys)
    assert (keys[order] == np.repeat(heads, n)).all() and sorted(order.tolist()) == list(range(500)) and len(heads) == 40
    keys = np.array([5, 6, 5, 6, 5]) << 61  # so that mixed keys differ only in few bits
    order, heads, n = ctw._runs(keys)
    assert (keys[order] == np.repeat(heads, n)).all() and sorted(order.tolist()) == list(range(5))


def test_answers_are_pressed_without_loss():
    logs = np.concatenate((-np.random.default_rng(4).random(1000).astype(np.float32) * 3, np.float32([-12.0, 0.0])))
    packed = ctw._pressed_logs(logs)
    assert (ctw._loose_logs(packed) == logs).all() and len(packed) < 0.9 * logs.nbytes and len(ctw._loose_logs(ctw._pressed_logs(logs[:0]))) == 0
