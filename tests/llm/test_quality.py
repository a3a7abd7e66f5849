"""Quality rules: counts by Python and SQL, accuracies by plain expectation-maximisation."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.llm import quality
from graphloom.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The contract's five counts, and base_failed."""
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    repeated = {i + k for starts in at.values() if len(starts) > 1 for i in starts for k in range(8)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), n < 20 or 100 * len(repeated) > 30 * n)


def expectation_maximisation(patterns, p=quality.Params()):
    """Posterior of each pattern of votes, by plain loops."""
    rules = len(quality.RULES)
    share, on_good, on_bad = p.share, [p.on_good] * rules, [p.on_bad] * rules

    def good(votes):
        g, b = share, 1 - share
        for i, v in enumerate(votes):
            g *= {1: on_good[i], -1: 1 - on_good[i], 0: 1}[v]
            b *= {1: 1 - on_bad[i], -1: on_bad[i], 0: 1}[v]
        return g / (g + b)

    held = lambda x: min(max(x, 1 - p.surest), p.surest)
    for _ in range(p.rounds):
        weight = {v: n * good(v) for v, n in patterns.items()}
        rate = lambda right, wrong, start: held((right + p.weight * start) / (right + wrong + p.weight))  # noqa: E731, B023
        of = lambda i, v, f: sum(f(x) for x in patterns if x[i] == v)
        good_in, bad_in = weight.__getitem__, lambda x: patterns[x] - weight[x]  # noqa: B023
        new_good = [rate(of(i, 1, good_in), of(i, -1, good_in), p.on_good) for i in range(rules)]
        new_bad = [max(rate(of(i, -1, bad_in), of(i, 1, bad_in), p.on_bad), 1 - new_good[i]) for i in range(rules)]
        total = sum(patterns.values())
        share, on_good, on_bad = held((sum(weight.values()) + p.weight * p.share) / (total + p.weight)), new_good, new_bad
    return {v: good(v) for v in patterns}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_table(spark, sf):
    got = QUERIES["op13_quality_rules"](spark, f"/root/testdata/{sf}").collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: tuple(r[c] for c in names) for r in got} == {i: plain(t) for i, t in texts.items()}
    votes = lambda r: tuple({"+": 1, "-": -1, "0": 0}[c] for c in r["votes"])
    good = expectation_maximisation(Counter(votes(r) for r in got if not r["base_failed"]))
    assert all(r["kept"] == (not r["base_failed"] and good[votes(r)] >= 0.5) for r in got if not r["base_failed"])
    assert not any(r["kept"] for r in got if r["base_failed"])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    want = con.sql(ORACLES["op13_quality_rules"])
    assert sorted(map(tuple, got)) == sorted(want.select(*got[0].asDict()).fetchall())


def test_clean_documents_stay_and_junk_goes(spark):
    d = "/root/testdata/sf0.1"
    got = QUERIES["op13_quality_rules"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where(~F.col("base_failed"))
    rows = {(r["quality"], r["kept"]): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert rows[1, True] > 0.995 * (rows[1, True] + rows.get((1, False), 0))
    assert rows.get((0, False), 0) > 0.95 * (rows.get((0, True), 0) + rows.get((0, False), 0))


CASES = [None, "", "   \n ", "a b", "x " * 40, "one two three four five six seven eight " * 2, "é è \x0b# \x85 | a\r\n\r\nb\nb\n b\nb", "a a a a a a a a", "a a a a a a a a a", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 0 2 3 4 5 6 7 8 9", "$& é!? 😀 &&\n\n" * 9]


def test_counts_of_odd_texts(spark):
    texts = CASES + [f"{'w ' * k}tail" for k in range(6, 12)] + [" ".join(str(i * i % 7) for i in range(300))]
    rows = quality.measured(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for r in rows:
        assert tuple(r[c] for c in names) == plain(texts[r["doc_id"]]), texts[r["doc_id"]]
    assert {r["doc_id"]: r["n_letterless"] for r in rows}[9] == 26 and {r["doc_id"]: r["n_letterless"] for r in rows}[6] == 3


def test_very_long_texts(spark):
    text = " ".join(str(i * 7919 % 40_009) for i in range(120_000)) + "\n" + "a" * 1_000_000 + "!" * 100_000
    (r,) = quality.measured(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert r["n_words"] == 120_001 and r["n_repeat_words"] == plain(text)[4]


def test_accuracies_of_the_rules_are_found(spark):
    import random

    rng, rules = random.Random(4), len(quality.RULES)
    accuracy, rows = [0.7 + 0.02 * (i % 10) for i in range(rules)], []
    for _ in range(6000):
        y = 1 if rng.random() < 0.7 else -1
        rows.append(([0 if rng.random() < 0.2 else y if rng.random() < a else -y for a in accuracy],))
    model = quality.fit(spark.createDataFrame(rows, "votes array<int>").withColumn("base_failed", F.lit(False)))
    assert abs(model.share - 0.7) < 0.03
    assert all(abs(g - a) < 0.05 and abs(b - a) < 0.05 for g, b, a in zip(model.on_good, model.on_bad, accuracy, strict=True))


def test_posterior_by_brute_force(spark):
    rows = [([1] * 12,)] * 50 + [([-1] * 3 + [1] * 9,)] * 9 + [([0] * 12,)] * 3
    voted = spark.createDataFrame(rows, "votes array<int>").withColumn("base_failed", F.lit(False))
    want = expectation_maximisation(Counter(tuple(v) for (v,) in rows))
    got = voted.distinct().select("votes", quality.quality(F.col("votes"), quality.fit(voted)).alias("q")).collect()
    assert all(math.isclose(r["q"], want[tuple(r["votes"])], rel_tol=1e-9) for r in got)


def test_nulls_repeats_empty_tables_and_clashing_names(spark):
    schema = "doc_id int, text string, kept string, n_words string, votes int, part0_row int"
    rows = [(1, None, "a", None, 1, 1), (1, "x", None, "b", None, 2), (None, "The river runs to the sea. " * 3 + "It bends twice by seven old mills and then a long low bridge.", "c", "d", 2, 3)] * 2
    got = quality.judged(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "kept", "n_words", "votes", "part0_row", "quality", "part1_kept"]
    assert sorted(map(str, (r[:6] for r in got.collect()))) == sorted(map(str, rows))
    assert quality.judged(spark.createDataFrame([], schema)).collect() == []
