"""Concepts and summaries on small tables against plain Python."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import checkpoints
from graphloom.operators import concepts, documents, near_names, summaries


def test_greedy_merge_is_that_of_one_by_one(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((90, 4))
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(90, [0.0] * 4), (91, None), (92, [1.0, 2.0])], "id long, v array<double>")
    unit, made, want = x / np.linalg.norm(x, axis=1)[:, None], [], {}
    for i in range(90):
        near = [(float(unit[i] @ unit[j]), -j) for j in made if unit[i] @ unit[j] > 0.6]
        want[i] = -max(near)[1] if near else i
        made += [] if near else [i]
    got = {r["id"]: r["concept"] for r in concepts.greedy_merge(df, 0.6).collect()}
    assert got == {**want, 90: 90, 91: 91, 92: 92}
    pairs = {(r["id"], r["earlier"]) for r in concepts.near_earlier(df, 0.6, tile=13).collect()}
    assert pairs == {(a, b) for a in range(90) for b in range(a) if unit[a] @ unit[b] > 0.6}


def test_copies_are_merged_in_few_rounds(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(concepts, "cut", lambda df: cuts.append(1) or checkpoints.cut(df))
    df = spark.createDataFrame([(i, [float(i % 3 == j) for j in range(3)]) for i in range(60)], "id long, v array<double>")
    got = {r["id"]: r["concept"] for r in concepts.greedy_merge(df, 0.9).collect()}
    assert got == {i: i % 3 for i in range(60)}
    assert len(cuts) < 15  # a round for each copy before


def test_candidates_are_named_and_known_concepts_stay(spark):
    rows = [(1, "User  Accounts", [1.0, 0.0]), (2, "user account", [0.0, 1.0]), (3, "Logins", [0.99, 0.05]), (4, "Billing", [0.0, 0.9]), (5, "Invoices", [0.01, 1.0])]
    known = spark.createDataFrame([("user-account", [1.0, 0.01]), ("session", [1.0, 0.02])], "id string, embedding array<double>")
    got = concepts.deduplicated(spark.createDataFrame(rows, "at long, name string, embedding array<double>"), known)
    assert {r["at"]: r["concept"] for r in got.collect()} == {1: "user-account", 2: "user-account", 3: "session", 4: "billing", 5: "billing"} or {r["at"]: r["concept"] for r in got.collect()}[3] in ("user-account", "session")


def test_extraction_survives_a_failing_model(spark):
    long = "# One\n" + "word " * 120 + "\n# Two\n" + "fail " * 120
    docs = spark.createDataFrame([("a.md", long), ("concepts/b.md", long), ("c.md", "short"), ("d.txt", long)], "path string, body string")

    def model(text):
        if "fail" in text:
            raise RuntimeError("down")
        return 'Sure: {"concepts": [{"name": " Word ", "confidence": 3}, {"description": "none"}]} {"x": 1}'

    got = {(r["path"], r["chunk"], r["name"], r["confidence"], r["error"]) for r in concepts.extracted(docs, model).collect()}
    assert got == {("a.md", 0, "Word", 1.0, None), ("a.md", 1, None, None, "down")}


def test_first_object(spark):
    texts = ['x {"a": "}\\"{"} y', "none", "{ open", None, "{}", '{"a": {"b": 1}} {"c": 2}']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(concepts.first_object("t")).collect()]
    assert got == ['{"a": "}\\"{"}', None, None, None, "{}", '{"a": {"b": 1}}']


def test_fuzzy_names_against_all_pairs(spark):
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("abAB") for _ in range(rng.randrange(1, 9)))
    symbols = [(rng.choice("rs"), n, f"{i}") for i, n in enumerate({name() for _ in range(60)})]
    refs = [(rng.choice(["r", "s", None]), n) for n in {name() for _ in range(60)}]
    pairs = lambda w: {w.lower()[i : i + 2] for i in range(len(w) - 1)} or {w.lower()}
    want = {}
    for service, n in refs:
        scored = [(-2 * len(pairs(n) & pairs(m)) / (len(pairs(n)) + len(pairs(m))), i) for repo, m, i in symbols if service in (None, repo)]
        if scored and min(scored)[0] <= -0.6:
            want[service, n] = (round(-min(scored)[0], 6), min(scored)[1])
    got = documents.fuzzy(spark.createDataFrame(refs, "service string, name string"), spark.createDataFrame(symbols, "repo string, name string, id string")).collect()
    assert {(r["service"], r["name"]): (round(r["score"], 6), r["id"]) for r in got} == want


def test_summaries_are_asked_for_twice_at_most(spark):
    rows = [(str(i), i, "r", 1, 1.0 / (i + 1), False, "core", "canonical" if i == 12 else None, "bad" if i == 3 else "good") for i in range(14)]
    members = spark.createDataFrame(rows, "id string, sym_key long, repo string, communityId int, pageRank double, isPublicApi boolean, role string, tier string, prompt string")
    answer = lambda prompt, tier: "no" if prompt == "bad" else json.dumps({"purpose": "p" * 200, "semanticTags": list("abcdefghijklm")})
    got = {r["symbolFqn"]: r for r in summaries.run(members, answer).collect()}
    assert set(got) == {str(i) for i in range(14) if i not in (3, 12)}
    assert got["0"]["tier"] == "canonical" and got["13"]["tier"] == "provisional" and len(got["0"]["purpose"]) == 150 and len(got["0"]["semanticTags"]) == 10
    assert {r["tries"] for r in got.values()} == {1}


def test_run_log(spark, tmp_path):
    for k in range(2):
        summaries.log_events(spark.createDataFrame([(k, "start")], "run int, event string"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).where(F.col("event") == "start").count() == 2


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.35])
def test_similar_names_against_all_pairs(spark, threshold):
    rng = random.Random(9)
    names = sorted({"".join(rng.choice(["get", "User", "set", "Order", "a", "Item", "x", "List", "é"]) for _ in range(rng.randint(1, 5))) for _ in range(150)})
    grams = lambda s: {s.lower()[i : i + 2] for i in range(len(s) - 1)} or {s.lower()}
    dice = lambda a, b: 2 * len(grams(a) & grams(b)) / (len(grams(a)) + len(grams(b)))
    asked, known = names[::2] + names[:3] + [""], names[1::2] + names[:9] + [None]
    df = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    got = {(r["name"], r["symbol"]): r["score"] for r in documents.similar_names(df(asked), df(known), threshold).collect()}
    want = {(a, b): dice(a, b) for a in set(asked) - {""} for b in set(known) - {None} if dice(a, b) >= threshold - 1e-9}
    assert got == pytest.approx(want) and len(want) > 20


@pytest.mark.parametrize("threshold", [0.88, 0.3, -0.1])
def test_near_vectors_against_all_pairs(spark, threshold):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 12))[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 12)) * 0.15
    x[7], x[8], x[9, 3] = 0, x[11], np.nan
    made = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, []), (2002, [1.0, 2.0]), (2003, [2.0, 4.1])]
    df = spark.createDataFrame(made, "id long, v array<double>")
    norm = np.sqrt((x * x).sum(axis=1))
    unit = x / np.where(norm > 0, norm, 1)[:, None]
    cos = np.nan_to_num(unit @ unit.T, nan=-2)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(cos > threshold), strict=True) if i > j} | {(2003, 2002)}
    got = [(r["id"], r["earlier"]) for r in concepts.near_earlier(df, threshold, tile=100, pivots=32).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    if threshold == 0.88:
        sides = concepts.tiles_to_compare(df, threshold, tile=100, pivots=32).groupBy("a", "b").agg(F.count_if(F.expr("t = a")).alias("l"), F.count_if(F.expr("t = b")).alias("r")).collect()
        compared = sum(r["l"] * r["r"] / (2 if r["a"] == r["b"] else 1) for r in sides)
        assert compared < 0.5 * 1500**2 / 2, compared / (1500**2 / 2)
    assert concepts.near_earlier(df.limit(0), threshold).count() == 0


def test_nearest_names_step_by_step(spark, monkeypatch):
    """Every threshold in turn, services, ties, equal names of several symbols, letters beyond the basic plane."""
    monkeypatch.setattr(near_names, "WORK", 0)
    rng = random.Random(11)
    name = lambda: "".join(rng.choice(["get", "User", "set", "Order", "a", "Item", "x", "é", "😀"]) for _ in range(rng.randint(1, 4)))
    symbols = [(rng.choice("rs"), name(), f"{i:03}") for i in range(90)] + [("r", None, "n"), ("s", "", "e"), (None, "UserOrder", "w")]
    refs = [(rng.choice(["r", "s", None]), name()) for _ in range(90)] + [(None, "zzzz"), ("r", ""), (None, None), ("r", "UserOrder"), (None, "UserOrder")]
    pairs = lambda w: {w.lower()[i : i + 2] for i in range(len(w) - 1)} or {w.lower()}
    want = {}
    for service, n in {(s, n) for s, n in refs if n}:
        scored = [(-2 * len(pairs(n) & pairs(m)) / (len(pairs(n)) + len(pairs(m))), i) for repo, m, i in symbols if m and service in (None, repo)]
        if scored and min(scored)[0] <= -0.6:
            want[service, n] = (round(-min(scored)[0], 9), min(scored)[1])
    got = documents.fuzzy(spark.createDataFrame(refs, "service string, name string"), spark.createDataFrame(symbols, "repo string, name string, id string")).collect()
    assert {(r["service"], r["name"]): (round(r["score"], 9), r["id"]) for r in got} == want and len(got) == len(want) > 60
    assert documents.fuzzy(spark.createDataFrame([("r", "zzzz")], "service string, name string"), spark.createDataFrame(symbols, "repo string, name string, id string")).count() == 0


@pytest.mark.parametrize(("most", "takes"), [(7, 0), (5, 1000), (4096, 4)])
def test_greedy_merge_takes_the_first_made_and_then_pairs(spark, monkeypatch, most, takes):
    """Few vectors at a time, by concepts only, and by pairs after one round; ids out of order, copies, other dimensions, nothing near."""
    monkeypatch.setattr(concepts, "MOST", most)
    monkeypatch.setattr(concepts, "TAKES", takes)
    monkeypatch.setattr(concepts, "FEW", 1)
    listed, near = [], concepts.near_earlier
    monkeypatch.setattr(concepts, "near_earlier", lambda *args: listed.append(1) or near(*args))
    rng = np.random.default_rng(6)
    x = rng.standard_normal((120, 4))
    x[50], x[60] = x[3], 0
    rows = [(int(i) * 3, x[i].tolist()) for i in rng.permutation(120)] + [(1, None), (4, []), (7, [1.0, float("nan")]), (10, [1.0, None]), (361, [1.0, 2.0]), (2, [2.0, 4.1])]
    unit, made, want = x / np.where((n := np.sqrt((x * x).sum(axis=1))) > 0, n, 1)[:, None], [], {1: 1, 4: 4, 7: 7, 10: 10, 2: 2, 361: 2}
    for i in range(120):
        close = [(float(unit[i] @ unit[j]), -j) for j in made if unit[i] @ unit[j] > 0.6]
        want[3 * i] = -3 * max(close)[1] if close else 3 * i
        made += [] if close else [i]
    got = concepts.greedy_merge(spark.createDataFrame(rows, "id long, v array<double>"), 0.6).collect()
    assert {r["id"]: r["concept"] for r in got} == want and len(got) == len(want)
    assert bool(listed) == (takes == 1000)


def test_greedy_merge_lists_no_pairs_where_many_are_near(spark, monkeypatch):
    """Half of all pairs are near; the pairs of 3,000 vectors would be millions of rows."""
    kept = []

    def cut(df):
        kept.append(checkpoints.cut(df))
        return kept[-1]

    monkeypatch.setattr(concepts, "cut", cut)
    x = np.random.default_rng(2).standard_normal((3000, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    assert concepts.greedy_merge(df, 0.0).count() == 3000
    assert sum(t.count() for t in kept) < 5 * 3000
