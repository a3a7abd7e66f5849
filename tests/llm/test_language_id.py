"""Language ID: accuracy on rows held out, and its cases."""

import numpy as np

from graphloom.llm import language_id
from graphloom.llm.common import remainder
from graphloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op1_language_id"](spark, SF).collect()
    assert len(rows) == len(truth) and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]] and r["lang_pred"] != "und"]
    assert len(held) > 100
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.9


def test_counts_are_those_of_plain_counting(spark):
    docs = spark.createDataFrame([(1, "ab ab", "x"), (2, "cd", "y"), (3, None, "x"), (4, "zz", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.languages == ["x", "y"]
    p = model.params
    for k, text in enumerate(["ab ab", "cd"]):
        count = np.bincount(language_id.features(text, p), minlength=1 << p.bits) + p.alpha
        assert np.allclose(model.log_prob[k], np.log(count / count.sum()))


def test_cases(spark):
    train = spark.createDataFrame([(1, "hello world", "en"), (2, "hallo welt", "de")], "doc_id long, text string, lang string")
    rows = [(1, None, 1), (2, "", 2), (3, "12 34 !?", 3), (4, "hallo welt", 4), (4, "hallo welt", 4), (5, "hello " * 50_000, 5), (6, "ЖЗ 𐐀", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    out = language_id.identify(docs, language_id.fit(train))
    got = sorted((r["doc_id"], r["lang_pred"]) for r in out.collect())
    assert got[:6] == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de"), (5, "en")] and got[6][1] != "und"
    assert set(out.columns) == {"doc_id", "text", "lang_pred", "score"}
    assert out.where(language_id.accepted()).where("doc_id <= 3").count() == 0
    assert language_id.identify(docs.where("false"), language_id.fit(train)).count() == 0
    nothing = language_id.fit(train.where(remainder("doc_id", 1) == 1))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}
