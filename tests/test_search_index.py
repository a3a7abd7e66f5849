"""The kept index against plain BM25, and after documents have changed."""

import math
import random
import re
from collections import Counter

import pytest

from graphloom.operators import doc_writes, search_index

DOCS, QUERIES = "path string, text string", "query int, text string"


def words(text):
    return [w for w in re.split(r"[^\w]+", (text or "").lower().replace("_", " ")) if w]


def plain(docs, queries, k=10):
    bags = {p: Counter(words(t)) for p, t in docs}
    n, mean = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    out = set()
    for q, text in queries:
        scores = []
        for p, bag in bags.items():
            s = 0.0
            for w in set(words(text)):
                df = sum(w in b for b in bags.values())
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * sum(bag.values()) / mean)) if bag[w] else 0
            if s:
                scores.append((-round(s + 1e-9, 4), p))
        out |= {(q, p, -s) for s, p in sorted(scores)[:k]}
    return out


def made(seed, n=40):
    rng = random.Random(seed)
    return [(f"d{i}", " ".join(rng.choice("pay flow Élan straße x1 order the the the list".split()) for _ in range(rng.randint(0, 30)))) for i in range(n)]


def found(spark, postings, lengths, queries):
    return {tuple(r) for r in search_index.search(postings, lengths, spark.createDataFrame(queries, QUERIES)).select("query", "path", "score").collect()}


ASKED = [(1, "the Pay-flow"), (2, "élan, ÉLAN straße!"), (3, "nothing"), (4, ""), (5, "x1 order list")]


def test_scores_against_plain_bm25(spark):
    docs = made(1) + [("empty", ""), ("null", None)]
    postings, lengths = search_index.indexed(spark.createDataFrame(docs, DOCS))
    got, want = found(spark, postings, lengths, ASKED), plain(docs, ASKED)
    assert {x[:2] for x in got} == {x[:2] for x in want}
    assert {x[:2]: x[2] for x in got} == pytest.approx({x[:2]: x[2] for x in want}, abs=2e-4)


def test_only_what_changed_is_indexed_anew(spark):
    docs = made(2)
    frame = lambda rows: spark.createDataFrame(rows, DOCS)
    postings, lengths = search_index.indexed(frame(docs))
    # those that stay as they were keep their rows, whatever these say: they aren't read again
    marked = postings.where("path = 'd5'").selectExpr("term", "path", "tf + 100 AS tf").unionByName(postings.where("path <> 'd5'"))
    after = [("d0", "brand new words")] + [d for d in docs[2:]] + [("late", "pay pay")]
    now, sizes = search_index.refreshed(marked, lengths, frame(after))
    got = {(r["term"], r["path"]): r["tf"] for r in now.collect()}
    want = {(w, p): c + (100 if p == "d5" else 0) for p, t in after for w, c in Counter(words(t)).items()}
    assert got == want
    assert {r["path"]: r["length"] for r in sizes.collect()} == {p: len(words(t)) for p, t in after}
    same, _ = search_index.refreshed(now, sizes, frame(after))
    assert {tuple(r) for r in same.collect()} == {tuple(r) for r in now.collect()}


def test_empty_index(spark):
    postings, lengths = search_index.indexed(spark.createDataFrame([], DOCS))
    assert found(spark, postings, lengths, ASKED) == set()
    postings, lengths = search_index.refreshed(postings, lengths, spark.createDataFrame([("a", "pay")], DOCS))
    assert {x[:2] for x in found(spark, postings, lengths, ASKED)} == {(1, "a")}


def test_proposals_leave_others_as_they_are(spark):
    fields = "path string, title string, type string, status string, author string, domain string, service string, updatedAt timestamp, lastEnrichedHash string, body string"
    old = spark.createDataFrame([(f"{doc_writes.PROPOSALS}old.md", None, None, "approved", None, None, None, None, None, "x")], fields)
    got = doc_writes.proposed(old, spark.createDataFrame([("new", "# New")], "name string, body string"))
    assert {(r["path"].split("/")[-1], r["status"]) for r in got.collect()} == {("old.md", "approved"), ("new.md", "proposed")}
    last = doc_writes.updated(old, spark.createDataFrame([("p", "zz", 1), ("p", "aa", 2)], "path string, body string, at int"))
    assert {r["body"] for r in last.collect()} == {"x", "aa"}
