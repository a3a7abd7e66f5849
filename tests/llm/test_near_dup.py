"""Near-duplicates against all pairs in plain Python."""

import random

import pytest

from graphloom.llm import near_dup
from graphloom.llm.components import components

SCHEMA = "doc_id long, text string"
WORDS = [f"w{i}" for i in range(400)]


def shingles(text, n=5):
    words = (text or "").lower().encode().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def smallest(nodes, pairs):
    root = {v: v for v in nodes}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {v: find(v) for v in nodes}


def brute(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label = smallest(ids, pairs)
    return {(i, len(sets[i]), label[i], label[i] == i) for i in ids}


def found(spark, rows, percent=80):
    got = near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA), near_dup.Params(percent=percent))
    return {tuple(r) for r in got.collect()}


def variants(seed):
    """Families of texts, with chains: each text differs a little from another of its family."""
    rng = random.Random(seed)
    rows = []
    for _ in range(12):
        family = [[rng.choice(WORDS) for _ in range(rng.randrange(30, 160))]]
        for _ in range(rng.randrange(6)):
            words = list(rng.choice(family))
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            family.append(words)
        rows += [" ".join(w) for w in family]
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


@pytest.mark.parametrize(("seed", "percent"), [(1, 80), (2, 85)])
def test_against_all_pairs(spark, seed, percent):
    rows = variants(seed)
    assert found(spark, rows, percent) == brute(rows, percent)


def test_nulls_empties_short_texts_and_case(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one  TWO\n"), (6, "one"), (7, "a b c d e f"), (8, "a b c d e f")]
    assert found(spark, rows) == brute(rows, 80)


def test_a_large_group_of_copies_and_near_copies(spark):
    base = [f"x{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(200)]
    rows += [(1000 + i, " ".join([*base[:60], f"y{i}", *base[61:]])) for i in range(150)]
    assert {r[2] for r in found(spark, rows)} == {0}


def test_repeated_rows_and_null_ids(spark):
    text = "a b c d e f g"
    rows = [(None, text), (5, text), (5, text), (None, "alone in the world it is")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 5), (5, 5), (5, 5)]


def test_empty_table_and_clashing_columns(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b c d e f", 7, "k"), (2, "a b c d e f", 8, "l"), (None, None, 9, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int, keys string")
    kept = near_dup.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r["component_id"] for r in kept.collect()) == [7, 9]


def test_components_of_long_paths(spark):
    n = 300
    order = list(range(n))
    random.Random(3).shuffle(order)
    pairs = [(order[i], order[i + 1]) for i in range(n - 1) if i % 50 != 49]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == smallest(range(n), pairs)


def test_a_shingle_in_most_texts_is_split_and_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SPLIT", 3)
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(70):
        own = [f"u{i}x{k}" for k in range(rng.randrange(3, 16))]
        rows.append((i, " ".join(rng.choice([passage + own, own + passage]))))
    assert found(spark, rows) == brute(rows, 80)
