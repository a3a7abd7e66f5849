"""Collocations against plain counting of all n-grams, and SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import collocations
from graphloom.llm.collocations import Layout, Params, Words, packed
from graphloom.llm.queries import ORACLES, QUERIES

SCHEMA = "text string, lang string"
NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, p=Params()):
    """The contract, word by word."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, p.max_n + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = []
        for ph, a in counts.items():
            if len(ph) < 2 or a < p.least:
                continue
            inside = any(b >= p.least and 100 * b >= p.inside * a and any(q[i : i + len(ph)] == ph for i in range(len(q) - len(ph) + 1)) for q, b in counts.items() if len(q) > len(ph) and b >= p.least)
            if inside:
                continue
            score, k = min((1_000_000 * a * a // (counts[ph[:k]] * counts[ph[k:]]), k) for k in range(1, len(ph)))
            found.append((-score, -a, " ".join(ph).encode(), counts[ph[:k]], counts[ph[k:]]))
        out += [(lang, i, ph.decode(), -a, left, right, n[lang], -s) for i, (s, a, ph, left, right) in enumerate(sorted(found)[: p.top], 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select(*NAMES).collect()))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_table_by_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    want = con.sql(ORACLES["op11_phrase_collocations"])
    got = found(QUERIES["op11_phrase_collocations"](spark, f"/root/testdata/{sf}"))
    assert got == sorted(want.select(*NAMES).fetchall()) and len(got) > 100


def texts(seed, n=400):
    rng = random.Random(seed)
    words = ["a", "B", "c\x01", "c", "dé", "é", "ab", "a\x00", "😀", "zz", "the", "The"]
    gaps = [" "] * 12 + ["\t", "  ", ", ", ".", "\n", "!? ", "\r\n", "\x0b"]
    return [("".join(rng.choice(words[: rng.choice([2, 6, 12])]) + rng.choice(gaps) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize("params", [Params(), Params(max_n=4, least=3, inside=80, chunk=2000), Params(max_n=2, least=2, top=7, chunk=500)])
def test_random_texts_by_brute_force(spark, params):
    rows = texts(params.max_n) + [(None, "en"), ("", None), ("  ...", "fr"), ("a a a a a a a a", "fr")]
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), params)
    assert found(got) == plain(rows, params)


def test_hot_prefixes_are_split_and_summed(spark):
    rows = [("of the " + " ".join(f"w{(i * k) % 97} of the" for k in range(40)), "en") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    params = Params(chunk=4000)
    hot = collocations.layout(df, params)
    assert hot.places["en"]["of"] > 2 and hot.places["en"]["of the"] > 2
    w = Words([rows[1][0].encode()], 3)
    salts = w.salts(hot.places["en"])
    of = [i for i, c in enumerate(w.columns[0]) if w.words[int(c)].as_py() == "of"]
    assert len({salts[i] for i in of}) > 2 and {int(salts[i] % 16) for i in of} == {2}
    assert found(collocations.collocations(df, params)) == plain(rows, params)


def test_sample_steers_only_the_layout(spark, monkeypatch):
    rows = texts(11)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(collocations, "layout", lambda rows, params: Layout({"en": {"a": 3, "a a": 2, "zz": 5, "gone": 2}, "und": {"b": 2, "b the": 4}}))
    assert found(collocations.collocations(df)) == plain(rows)


def test_exact_beyond_64_bits(spark):
    big = 10_000_000_019
    rows = [("en", None, 0, 3 * big), ("en", "x", 1, big), ("en", "y", 1, big - 2), ("en", "x y", 2, big - 5)]
    (r,) = collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, words int, f long")).collect()
    assert r["score"] == 1_000_000 * (big - 5) ** 2 // (big * (big - 2))


def test_very_long_text_and_words(spark):
    text = "lorem ipsum " * 200_000 + "x" * 1_000_000 + " y. " + "a," * 100_000
    got = found(collocations.collocations(spark.createDataFrame([(text, "en")], SCHEMA)))
    assert got == plain([(text, "en")]) and len(got) == 2


def test_empty_tables_and_clashing_names(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    wide = spark.createDataFrame([("b c " * 20, 1, "fr", 2, 3)], "text string, n int, lang string, phrase int, rank int")
    assert found(collocations.collocations(wide)) == plain([("b c " * 20, "fr")])


def test_packing_keeps_the_order():
    rng = np.random.default_rng(2)
    columns = [rng.integers(0, 1 << 40, 300), rng.integers(0, 3, 300), rng.integers(0, 1 << 35, 300)]
    columns = [np.repeat(c, 2) for c in columns]
    assert (np.argsort(packed(columns), kind="stable") == np.lexsort(columns[::-1])).all()
    assert len(packed([np.empty(0, np.int64)] * 2)) == 0


def test_words_of_a_chunk():
    w = Words([b"B a.a\tC\xc3\x89", b"", b" ,x"], 3)
    assert [[w.words[int(c)].as_py() for c in row] for row in zip(*w.columns, strict=True)] == [["b", "a", ""], ["a", "", ""], ["a", "cÉ", ""], ["cÉ", "", ""], ["x", "", ""]]
    assert isinstance(w.words, pa.StringArray)
