"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import ann, collocations, ctw, language_id, near_dup, packing, pii, quality, secrets, sentencepiece_codec, topk, url_filter, vector_codes
from graphloom.llm.common import checkpointed, is_remainder, read, remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(remainder("doc_id", 3) != 1))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", is_remainder("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), packing.Params(public_tokenizers.path("word_bpe_49k.json")))


@query
def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


@query
def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.inner_product_search(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


ORACLES["op10_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""


@query
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"), near_dup.Params(percent=85))


ORACLES["op5_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t
  FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
        ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS k FROM g),
e AS (SELECT doc_id, unnest(s) AS x FROM g),
f AS (SELECT x FROM e GROUP BY x HAVING count(*) > 1),
c AS (SELECT e.* FROM e JOIN f USING (x)),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM c a JOIN c b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * i >= 85 * (a.k + b.k - i)),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, l.v FROM r JOIN l ON l.u = r.reached)
SELECT n.doc_id, CAST(n.k AS BIGINT) AS n_shingles, min(r.reached) AS component_id, n.doc_id = min(r.reached) AS kept
FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.k
"""


@query
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents")))


#: The fixed rules of the URL filter.
URL_RULES = [
    url_filter.Rule("net", "/", url_filter.BLOCK),
    url_filter.Rule("example.net", "/en/", url_filter.ALLOW),
    url_filter.Rule("example.com", "/de/", url_filter.BLOCK),
    url_filter.Rule("org", "/fr/", url_filter.ALLOW),
]


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages share ids with ``labels``: a page of low quality or with toxic text is to block."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when(bad, url_filter.BLOCK).otherwise(url_filter.ALLOW).alias("label"))
    labelled = url_filter.split_url(pages).withColumn("items", url_filter.tokens()).join(labels, "page_id")
    return url_filter.judge(pages, URL_RULES, url_filter.mined(labelled)).select("page_id", "host", "path", "rule", "verdict")


@query
def op2_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = ctw.fit(docs.where(remainder("doc_id", 7) != 2))
    return ctw.score(docs, model, held_out=is_remainder("doc_id", 7, 2))


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents and decodes them again."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = sentencepiece_codec.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path)
    docs = sentencepiece_codec.decode(docs, path, text_out="decoded")
    digest = F.crc32(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").cast("binary"))
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_ids"), digest.alias("ids_crc32"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.with_label_error(vector_codes.encode(read(spark, sf_dir, "embeddings")))


def _vector_codes_sql(rounds: int = 4) -> str:
    """Lloyd's rounds one by one; doubles are exact for whole numbers of this size."""
    parts = ["""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, k.part, e[k.part * (len(e) // 4) + 1 : (k.part + 1) * (len(e) // 4)] AS x FROM v, (SELECT unnest(range(4)) AS part) k),
c0 AS MATERIALIZED (SELECT part, entry, x AS c FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < 256) USING (vec_id))"""]
    for k in range(rounds + 1):
        parts.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, part, min(struct_pack(d := list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), entry := entry)) AS best
  FROM p JOIN c{k} USING (part) GROUP BY vec_id, part)""")
        if k < rounds:
            parts.append(f"""m{k} AS MATERIALIZED (SELECT part, entry, list(m ORDER BY place) AS m FROM (
  SELECT part, best.entry AS entry, place, floor(sum(x[place]) / count(*)) AS m FROM a{k} JOIN p USING (vec_id, part), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS place) GROUP BY ALL) GROUP BY part, entry),
c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m, c) AS c FROM c{k} LEFT JOIN m{k} USING (part, entry))""")
    return "WITH " + ",\n".join(parts) + f""",
h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}),
r AS (SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT r.vec_id, v.label, code, error, CAST(sum(error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN v USING (vec_id), h"""


ORACLES["op12_vector_codes"] = _vector_codes_sql()


@query
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``votes``: + good, - bad, 0 abstains, in order of the rules."""
    found = checkpointed(quality.measured(read(spark, sf_dir, "documents").select("doc_id", "text")))
    model = quality.fit(found)
    votes = F.array_join(F.transform("votes", lambda v: F.when(v == 1, "+").when(v == -1, "-").otherwise("0")), "")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *counts, "base_failed", quality.kept(F.col("votes"), F.col("base_failed"), model).alias("kept"), votes.alias("votes"))


def _quality_sql(p: quality.Params = quality.Params()) -> str:
    """The counts, the votes, and expectation-maximisation as a recursive query over the patterns of votes."""
    gap, n = r"\x20\x09-\x0D", len(quality.RULES)
    votes = ", ".join(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END" for r in quality.RULES)
    odds = f"ln(share / (1 - share)) + list_sum(list_transform(range(1, {n + 1}), lambda i: CASE votes[i] WHEN 1 THEN ln(on_good[i] / (1 - on_bad[i])) WHEN -1 THEN ln((1 - on_good[i]) / on_bad[i]) ELSE 0 END))"
    held = lambda x: f"greatest({1 - p.surest}, least({p.surest}, {x}))"
    rate = lambda right, wrong, start: held(f"({right} + {p.weight * start}) / ({right} + {wrong} + {p.weight})")
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[{gap}]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{gap}]')) AS lines FROM t),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {p.window - 1}], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, len(w) - {p.window - 2})) AS i)),
twice AS (SELECT doc_id, unnest(range(i, i + {p.window})) AS word FROM win WHERE (doc_id, s) IN (SELECT doc_id, s FROM win GROUP BY ALL HAVING count(*) > 1)),
rep AS (SELECT doc_id, count(DISTINCT word) AS n_repeat_words FROM twice GROUP BY doc_id),
m AS MATERIALIZED (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{{L}}'))) AS n_letterless,
  len(list_filter(w, lambda x: regexp_full_match(x, '[\p{{L}}\p{{M}}]+(?:[''’-][\p{{L}}\p{{M}}]+)*[.,;:!?]?'))) AS n_plain,
  len(regexp_extract_all(t, '[^{gap}\p{{L}}\p{{M}}\p{{N}}]{{3,}}')) AS n_runs,
  len(list_filter(lines, lambda x: regexp_matches(x, '[.!?][{gap}]*\z'))) AS n_ended_lines, len(list_distinct(w)) AS n_distinct,
  length(regexp_replace(t, '\P{{L}}+', '', 'g')) AS n_letters, length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS n_capitals,
  length(regexp_replace(t, '[^!?]+', '', 'g')) AS n_exclaims
  FROM w LEFT JOIN rep USING (doc_id)),
v AS MATERIALIZED (SELECT *, [{votes}] AS votes, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
p AS MATERIALIZED (SELECT votes, CAST(count(*) AS DOUBLE) AS n FROM v WHERE NOT base_failed GROUP BY votes),
em AS (SELECT 0 AS k, CAST({p.share} AS DOUBLE) AS share, list_transform(range({n}), lambda i: CAST({p.on_good} AS DOUBLE)) AS on_good, list_transform(range({n}), lambda i: CAST({p.on_bad} AS DOUBLE)) AS on_bad
  UNION ALL
  SELECT k + 1, any_value({held(f"(good + {p.weight * p.share}) / (n + {p.weight})")}), list(g ORDER BY i), list(greatest(b, 1 - g) ORDER BY i) FROM (
    SELECT k, i, sum(n) AS n, sum(good) AS good,
      {rate("sum(CASE WHEN vote = 1 THEN good ELSE 0 END)", "sum(CASE WHEN vote = -1 THEN good ELSE 0 END)", p.on_good)} AS g,
      {rate("sum(CASE WHEN vote = -1 THEN n - good ELSE 0 END)", "sum(CASE WHEN vote = 1 THEN n - good ELSE 0 END)", p.on_bad)} AS b
    FROM (SELECT k, n, unnest(votes) AS vote, unnest(range({n})) AS i, n / (1 + exp(-({odds}))) AS good FROM p, em WHERE k < {p.rounds}) GROUP BY k, i) GROUP BY k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 1 / (1 + exp(-({odds}))) >= {p.least} AS kept,
  array_to_string(list_transform(votes, lambda x: CASE x WHEN 1 THEN '+' WHEN -1 THEN '-' ELSE '0' END), '') AS votes
FROM v, em WHERE k = {p.rounds}"""


ORACLES["op13_quality_rules"] = _quality_sql()


@query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents").select("text", "lang"))


ORACLES["op11_phrase_collocations"] = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT d, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k)),
f AS MATERIALIZED (SELECT lang, w[i:i + k - 1] AS ph, k, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, ph, k, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k >= 2 AND f >= 10),
s AS (SELECT c.lang, c.ph, c.k, a, cut, l.f AS l, r.f AS r, CAST(1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.ph = c.ph[1:cut] JOIN f r ON r.lang = c.lang AND r.ph = c.ph[cut + 1:c.k]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, cut) = 1),
o AS (SELECT lang, sub, max(f) AS longer FROM (SELECT lang, f, unnest([ph[1:2], ph[2:3]]) AS sub FROM f WHERE k = 3 AND f >= 10) GROUP BY ALL),
z AS (SELECT b.lang, array_to_string(b.ph, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN o ON o.lang = b.lang AND o.sub = b.ph WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM z)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
