"""URL rules against plain Python; SentencePiece segmentation against a plain Viterbi search."""

import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from graphloom.llm import sentencepiece_codec, url_filter
from graphloom.llm.queries import QUERIES, URL_RULES

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("piece_bpe_32k.model")


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    cut = lambda s, stops: s[: min([s.index(c) for c in stops if c in s], default=len(s))]
    host = cut(rest, "/?#")
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return low, cut(rest[len(host) :], "?#")


def rule(host, path):
    fitting = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fitting, key=lambda r: len(r.name), default=None)


def test_pages(spark):
    url = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op7_url_filter"](spark, SF).collect()
    assert len(rows) == len(url)
    for r in rows:
        assert (r["host"], r["path"]) == split(url[r["page_id"]])
        fixed = rule(r["host"], r["path"])
        assert r["rule"] == (fixed.name if fixed else None)
        assert r["verdict"] in ({fixed.verdict} if fixed else {"allow", "block"})


def test_url_cases(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y://z", "x://net#/", "a://b://c/d", "http://É.org/fr/ü", "http://example.com?/de/", "http://sub.example.com/de/", "http://notexample.com/de/"]
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'old' AS rule", "1 AS host"), URL_RULES, []).collect()
    for r in rows:
        fixed = rule(*split(r["url"]))
        assert (r["host"], r["path"]) == split(r["url"])
        assert (r["rule"], r["verdict"]) == ((fixed.name, fixed.verdict) if fixed else (None, "allow"))


def test_mined_rules(spark):
    rng = random.Random(1)
    urls = [(f"http://h{i % 7}.com/{'casino/' if i % 3 == 0 else ''}{'win/' if i % 2 == 0 else ''}p{rng.randrange(9)}", "block" if i % 6 == 0 else "allow") for i in range(600)]
    labelled = url_filter.split_url(spark.createDataFrame(urls, "url string, label string")).withColumn("items", url_filter.tokens())
    rules = url_filter.mine(labelled)
    assert [set(r.items) for r in rules] == [{"p:casino", "p:win"}]
    got = url_filter.judge(spark.createDataFrame([("http://x.de/win/a/casino",), ("http://x.de/win/",)], "url string"), [], rules).collect()
    assert [r["verdict"] for r in got] == ["block", "allow"]
    assert url_filter.mine(labelled.where("false")) == []


def test_copies_of_sure_rules_displace_no_other(spark):
    hosts = [f"http://{c}u.{c}v.{c}w/{c}x/{c}y/{c}z" for c in "abcdefghijkl"]
    urls = [(u, "block") for u in hosts for _ in range(30)] + [("http://ok.org/spam", "block" if i < 46 else "allow") for i in range(50)] + [("http://ok.org/fine", "allow")] * 50
    labelled = url_filter.split_url(spark.createDataFrame(urls, "url string, label string")).withColumn("items", url_filter.tokens())
    assert {r.items for r in url_filter.mine(labelled)} == {frozenset([t]) for c in "abcdefghijkl" for t in (f"d:{c}w", f"d:{c}v.{c}w", f"h:{c}u", f"h:{c}v", f"h:{c}w", f"p:{c}x", f"p:{c}y", f"p:{c}z")} | {frozenset(["p:spam"])}
    pages = spark.createDataFrame([("http://q.de/spam/",), ("http://lu.de/",), ("http://q.de/fine",), ("",), (None,), ("http://q.de/spam/",)], "url string")
    rules = url_filter.mined(labelled)
    for most in (5, 500):  # joined, and in the plan
        got = url_filter.judge(pages, [], rules, params=url_filter.Params(max_rules=most)).collect()
        assert sorted((r["url"] or "", r["verdict"]) for r in got) == [("", "allow"), ("", "allow"), ("http://lu.de/", "block"), ("http://q.de/fine", "allow"), ("http://q.de/spam/", "block"), ("http://q.de/spam/", "block")]


def test_rules_need_a_count_of_rows_and_no_share(spark):
    # of 10,000 rows, 25 and 24 are far below half a percent
    urls = [(f"http://a.org/{'xyz'[i % 3]}", "allow") for i in range(9_951)] + [("http://bad.net/q", "block")] * 25 + [("http://few.de/r", "block")] * 24
    labelled = url_filter.split_url(spark.createDataFrame(urls, "url string, label string")).withColumn("items", url_filter.tokens())
    rules = url_filter.mine(labelled)
    assert {r.items for r in rules} == {frozenset([t]) for t in ("d:net", "d:bad.net", "h:bad", "h:net", "p:q")}
    assert {(r.confidence, r.support) for r in rules} == {(1.0, 25 / 10_000)}
    assert url_filter.mine(labelled.where("label = 'block'").limit(24)) == []


def test_rules_fire_on_pages_and_hold_on_others(spark):
    """URLs of the test table with labels that depend on them, by and large."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    bad = F.col("url").rlike("//m[.]") & F.col("url").rlike("/en/") | F.col("url").rlike("[?]page=.*ref=")
    noise = F.pmod(F.xxhash64("page_id"), F.lit(100)) < 3
    labelled = url_filter.split_url(pages).withColumn("items", url_filter.tokens()).withColumn("label", F.when(bad != noise, "block").otherwise("allow"))
    held = F.pmod(F.xxhash64(F.lit(7), "page_id"), F.lit(5)) == 0
    rules = url_filter.mined(labelled.where(~held))
    assert {frozenset(["h:m", "p:en"])} <= {frozenset(r["items"]) for r in rules.collect()}
    got = url_filter.judge(labelled.where(held), [], rules).groupBy("verdict", "label").count().collect()
    n = {(r["verdict"], r["label"]): r["count"] for r in got}
    blocked = n["block", "block"] + n.get(("block", "allow"), 0)
    assert blocked > 20 and n["block", "block"] >= 0.9 * blocked
    assert n["block", "block"] >= 0.8 * (n["block", "block"] + n.get(("allow", "block"), 0))


def test_tokens_that_come_together_are_not_combined(spark):
    # 60 tokens in the same 40 rows are 2 ** 60 combinations, and none is sure without "x"
    tail = "-".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))
    urls = [(f"http://a.org/{tail}", "block" if i % 2 else "allow") for i in range(80)] + [(f"http://a.org/{tail}/x", "block")] * 40 + [("http://a.org/x", "allow")] * 40
    labelled = url_filter.split_url(spark.createDataFrame(urls, "url string, label string")).withColumn("items", url_filter.tokens())
    assert [set(r.items) for r in url_filter.mine(labelled)] == [{"p:waa", "p:x"}]
    assert url_filter.judge(labelled, [], url_filter.mined(labelled)).where("verdict = 'block'").count() == 40


def viterbi(text, v, piece_ids, longest):
    """Greatest total score of a marked text, with byte fallback by character."""
    data, fallback = text.encode(), float(v.scores.min()) - sentencepiece_codec.BYTE_PENALTY
    best = [-np.inf] * (len(data) + 1)
    best[0] = 0.0
    for i in range(len(data)):
        if best[i] == -np.inf:
            continue
        for j in range(i + 1, min(len(data), i + longest) + 1):
            if (k := piece_ids.get(data[i:j])) is not None:
                best[j] = max(best[j], best[i] + v.scores[k])
        if data[i] & 0xC0 != 0x80:
            width = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
            best[i + width] = max(best[i + width], best[i] + fallback * width)
    return best[-1]


def test_segmentation_has_the_best_score():
    v = sentencepiece_codec.load(PATH)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.model_of(v))
    piece_ids = {p: i for i, p in enumerate(v.pieces) if p}
    longest, fallback = max(map(len, piece_ids)), float(v.scores.min()) - sentencepiece_codec.BYTE_PENALTY
    rng = random.Random(2)
    texts = ["hello world", " two  spaces ", " ", "  ", "a ", "日本語 text 😀é", "\x00\x01", "x" * 400 + " word" * 90 + "ab" * 300, *["".join(rng.choice("abcde étß中😀 ") for _ in range(40)) for _ in range(30)]]
    is_byte = set(v.byte_ids.tolist())
    for text, raw in zip(texts, codec.encode(texts), strict=True):
        ids = np.frombuffer(raw, "<i4")
        total = sum(fallback if i in is_byte else v.scores[i] for i in ids)
        marked = sentencepiece_codec.MARKER + text.replace(" ", sentencepiece_codec.MARKER)
        assert np.isclose(total, viterbi(marked, v, piece_ids, longest), rtol=1e-6), text
        assert codec.decode(ids.tolist()) == text
    literal = ["a▁b ▁c", "▁", " ▁▁ "]
    assert [codec.decode(np.frombuffer(x, "<i4").tolist()) for x in codec.encode(literal)] == literal


def test_chunks_alone_and_together_alike():
    model = sentencepiece_codec.model_of(sentencepiece_codec.load(PATH))
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoin shrdluö中▁") for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    together, alone, tiny = (sentencepiece_codec.Codec(model, **k) for k in ({}, {"alone": 1}, {"cached": 3, "batch": 200}))
    want = together.encode(words)
    assert alone.encode(words) == want and tiny.encode(words) == want and together.encode(words) == want
    assert len(tiny.cache) <= 3


def test_documents_round_trip(spark):
    rows = QUERIES["op9_sentencepiece"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) and all(r["round_trip"] for r in rows)


def test_piece_cases(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a b", 0), (3, "a b", 0), (4, "word " * 20_000 + "x" * 5_000, 0), (5, "y" * 200_000 + " " * 3_000 + "é▁", 0)], "doc_id long, text string, ids int")
    coded = sentencepiece_codec.encode(docs, PATH)
    got = {(r["doc_id"], r["text"], r["back"]) for r in sentencepiece_codec.decode(coded, PATH, text_out="back").collect()}
    assert all(t == b for _, t, b in got) and len(got) == 5
    ids = {r["doc_id"]: r["ids"] for r in coded.collect()}
    assert ids[1] is None and ids[2] == []
    odd = spark.createDataFrame([(1, [5000, None, -1, 10**6]), (2, None)], "k long, ids array<int>")
    assert [r["text"] is None for r in sentencepiece_codec.decode(odd, PATH).orderBy("k").collect()] == [False, True]
    assert sentencepiece_codec.encode(docs.where("false"), PATH).count() == 0
