"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of up to three characters, hashed to a fixed number of buckets, in
one pass over a bounded sample of the labelled rows; the partial counts are summed by Spark.
The matrix of log probabilities (buckets x languages, both bounded) is broadcast, and a pandas
UDF scores a batch of documents at a time.

Cases: a null text, or one without a letter, is predicted as ``und`` with score 0. Rows with a
null or empty text add nothing to the model. With no labelled row at all every text is ``und``.
Repeated rows are scored (and learned from) as often as they occur. Equal scores go to the
language that sorts first. Other columns of the input stay; columns already called as the
outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
SPACE = 32
#: Odd multipliers of the n-gram hash, one for each place in the n-gram, and one to mix.
PLACE = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
MIX = np.uint32(0x27D4EB2F)


@dataclass(frozen=True)
class Params:
    """``train_docs_per_lang`` bounds the training sample: of a language with more labelled rows
    a share chosen by a hash of the id is taken, whose expected size is this."""

    bits: int = 16
    orders: int = 3
    alpha: float = 0.5
    train_docs_per_lang: int = 20_000
    max_languages: int = 256


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prob: np.ndarray  # languages x buckets
    log_prior: np.ndarray
    params: Params = field(default_factory=Params)


_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Of each code point below 65536: its lower case if it is a letter, else a space."""
    global _letters
    if _letters is None:
        low = [c.lower() if (c := chr(i)).isalpha() else " " for i in range(65536)]
        _letters = np.array([ord(x[0]) for x in low], np.uint32)
    return _letters


def folded(text: str) -> np.ndarray:
    """Code points: letters in lower case, each run of anything else as one space."""
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.full(len(raw) + 2, SPACE, np.uint32)
    wide = raw > 65535
    out[1:-1] = _letter_table()[np.where(wide, SPACE, raw)]
    if wide.any():
        out[1:-1][wide] = [x if chr(x).isalpha() else SPACE for x in raw[wide].tolist()]
    gap = out == SPACE
    return out[~(gap & np.concatenate(([False], gap[:-1])))]


def features(text: str | None, params: Params) -> np.ndarray:
    """Buckets of the text's n-grams; empty if it has no letter."""
    x = folded(text) if text else np.empty(0, np.uint32)
    if len(x) < 2:
        return np.empty(0, np.int64)
    parts = []
    for n in range(1, params.orders + 1):
        if len(x) >= n:
            h = np.full(len(x) - n + 1, n, np.uint32)
            for i in range(n):
                h ^= x[i : len(x) - n + 1 + i] * PLACE[i % 3]
                h = (h ^ (h >> np.uint32(15))) * MIX
            parts.append(h >> np.uint32(32 - params.bits))
    return np.concatenate(parts).astype(np.int64)


def _count_partition(params: Params):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = features(text, params)
                if len(found):
                    if lang not in total:
                        total[lang] = np.zeros(1 << params.bits, np.int64)
                    if len(found) > 4096:
                        total[lang] += np.bincount(found, minlength=1 << params.bits)
                    else:
                        np.add.at(total[lang], found, 1)
                    docs[lang] = docs.get(lang, 0) + 1
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            # bucket -1 carries the number of documents
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(counts[at], docs[lang]), pa.int64())],
                names=["lang", "bucket", "n"],
            )

    return count


def fit(train: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from the rows of ``train`` with a language."""
    rows = train.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where("l IS NOT NULL AND t IS NOT NULL")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).limit(params.max_languages + 1).collect()}
    if len(sizes) > params.max_languages:
        raise ValueError(f"more than {params.max_languages} languages; raise Params.max_languages")
    # the share of a language is a threshold on a hash of the id, so it reads no text of rows left out
    share = F.lit(1.0)
    for lang, n in sizes.items():
        if n > params.train_docs_per_lang:
            share = F.when(F.col("l") == lang, F.lit(params.train_docs_per_lang / n)).otherwise(share)
    rows = rows.where(F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(1 << 30)) < share * (1 << 30))
    counts = rows.select("l", "t").mapInArrow(_count_partition(params), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    table = np.zeros((len(languages), 1 << params.bits))
    docs = np.ones(len(languages))
    for k, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        real = own["bucket"].to_numpy() >= 0
        table[k, own["bucket"].to_numpy()[real]] = own["n"].to_numpy()[real]
        docs[k] = own["n"].to_numpy()[~real].sum()
    table += params.alpha
    log_prob = np.log(table) - np.log(table.sum(axis=1, keepdims=True))
    return Model(languages, log_prob, np.log(docs / max(1.0, docs.sum())), params)


def score_batch(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Of each text the likeliest language and its posterior probability."""
    found = [features(t, model.params) for t in texts]
    lengths = np.array([len(x) for x in found], np.int64)
    best, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    some = np.flatnonzero(lengths)
    if not len(some) or not model.languages:
        return best, score
    flat, starts = np.concatenate([found[i] for i in some]), np.cumsum(lengths[some]) - lengths[some]
    log = np.stack([np.add.reduceat(row[flat], starts) for row in model.log_prob], axis=1) + model.log_prior
    log -= log.max(axis=1, keepdims=True)
    post = np.exp(log)
    post /= post.sum(axis=1, keepdims=True)
    top = post.argmax(axis=1)
    for i, k in zip(some.tolist(), top.tolist(), strict=True):
        best[i] = model.languages[k]
    score[some] = post[np.arange(len(some)), top]
    return best, score


#: Documents whose n-grams are held at a time.
SLICE = 256


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(f"{lang_out} string, {score_out} double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = [], []
        for k in range(0, len(texts), SLICE):
            best, score = score_batch([t if isinstance(t, str) else None for t in texts.iloc[k : k + SLICE]], shared.value)
            langs += best
            scores.append(score)
        return pd.DataFrame({lang_out: pd.Series(langs, dtype=object), score_out: np.concatenate(scores) if scores else np.empty(0)})

    taken = set(docs.columns)
    name = next(x for i in range(len(taken) + 1) if (x := f"predicted_{i}") not in taken)
    out = docs.withColumn(name, predict(F.col(text_col)))
    return out.withColumns({lang_out: F.col(name)[lang_out], score_out: F.col(name)[score_out]}).drop(name)


def accepted(lang_out: str = "lang_pred", score_out: str = "score", least: float = 0.5) -> Column:
    """Whether a prediction is sure enough to keep the document."""
    return (F.col(lang_out) != UNDETERMINED) & (F.col(score_out) >= least)
