"""The pipeline stage by stage, and the queries of this folder that have SQL."""

import duckdb
import pytest

import corpus_pipeline
from graphloom.llm.queries import ORACLES, QUERIES
from tests.llm.test_near_dup import brute
from tests.llm.test_packing import pieces
from tests.llm.test_spans import SECRET, base

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got[columns].itertuples(index=False))) == sorted(map(tuple, want[columns].itertuples(index=False)))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
        if k < 3:
            assert kept[-1].columns == docs.columns
    rows = [{r["doc_id"]: r for r in df.collect()} for df in kept[:4]]
    letters = {i for i, r in rows[0].items() if r["text"] and any(c.isalpha() for c in r["text"])}
    assert set(rows[1]) <= letters and len(rows[1]) >= 0.9 * len(letters)
    labels = brute([(i, r["text"]) for i, r in rows[1].items()], 80)
    assert set(rows[2]) == {i for i, _, _, keep in labels if keep}
    assert set(rows[3]) == set(rows[2])
    for i, r in rows[3].items():
        if base(rows[2][i]["text"], SECRET, True):
            assert not base(r["text"], SECRET, True) and r["n_chars"] == len(r["text"])
        else:
            assert r["source"] == rows[2][i]["source"] and r["lang"] == rows[2][i]["lang"]
    packed = kept[4].collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == pieces([(i, r["text"]) for i, r in rows[3].items()])
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(corpus_pipeline.run(spark, SF).collect()) == key(packed)


def test_odd_rows_in_every_stage(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns; ``docs`` of each stage hold them all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, part0_score double, lang_pred string, kept string"
    plain = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], None, "x", "y") for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    long_text = " ".join(f"{a} of the {b}" for a in ("river", "house", "stone", "garden") for b in range(20_000))
    odd = [(9001, None, "en", "s", None), (9002, "", None, None, 0), (9003, "12 34 !", "en", "s", 7), (9004, long_text, None, None, len(long_text)), (None, plain[0][1], "en", None, None), plain[1][:5]]
    rows = plain + [(*r, 0.5, None, "n") for r in odd]
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(rows, schema)
        got = stage(spark, docs, SF)
        got.write.parquet(str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name))
        ids = {r["doc_id"] for r in got.select("doc_id").collect()}
        assert stage(spark, docs.limit(0), SF).collect() == []
        if name == "language_id":
            assert not ids & {9001, 9002, 9003}
        if name == "minhash_near_dedup":
            assert {9001, 9002, 9003, 9004} <= ids and got.where(f"doc_id = {plain[1][0]}").count() <= 1
        if name == "secret_scan":
            assert got.count() == len(rows) and got.where("doc_id = 9001 AND text IS NULL").count() == 1
        if name == "best_fit_packing":
            assert 9001 in ids and got.where("doc_id = 9004").count() > 50
        else:
            assert got.columns == docs.columns
