"""The graph that the test tables stand for: one view a table, as SQL for any engine.

The tables of the tests hold no code, so symbols, modules, calls and so on are derived from
them; each query of the catalogue runs an operator over these views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: In order of dependency.
VIEWS = {
    "sym": r"""
SELECT sym_key, repo, filePath, name, concat(repo, ':', filePath, '#', name) AS id, kind,
       isExported, docstring, communityId,
       CAST(10 * rn AS INT) AS lineStart, CAST(10 * rn + 8 AS INT) AS lineEnd
FROM (
  SELECT t.*, row_number() OVER (PARTITION BY repo, filePath ORDER BY sym_key) AS rn
  FROM (
    SELECT p_partkey AS sym_key,
      CASE WHEN p_partkey % 10 = 0 THEN 'aux' ELSE 'main' END AS repo,
      concat('src/', CASE p_size % 8 WHEN 0 THEN 'api' WHEN 1 THEN 'services' WHEN 2 THEN 'domain'
               WHEN 3 THEN 'repositories' WHEN 4 THEN 'infra' WHEN 5 THEN 'utils'
               WHEN 6 THEN 'config' ELSE 'misc' END,
             '/', replace(lower(p_brand), '#', '-'),
             CASE WHEN p_partkey % 13 = 0 THEN '.test.js' ELSE '.js' END) AS filePath,
      concat(CASE WHEN p_partkey % 17 = 0 THEN '_' ELSE '' END, upper(substr(p_name, 1, 1)),
             replace(substr(p_name, 2), ' ', '_'), '_', CAST(p_partkey AS STRING)) AS name,
      CASE p_partkey % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'variable' END AS kind,
      p_partkey % 2 = 0 AS isExported,
      CASE WHEN p_partkey % 19 = 0 THEN '@internal helper'
           WHEN p_partkey % 4 = 0 THEN concat('Handles ', p_name) END AS docstring,
      CAST(replace(p_brand, 'Brand#', '') AS INT) % 5 AS communityId
    FROM part) t) u
""",
    "mod": r"""
SELECT repo, filePath AS path, count(*) AS n_symbols, max(lineEnd) AS loc,
       length(filePath) % 7 = 0 AS isBarrel,
       row_number() OVER (ORDER BY repo, filePath) % 50 AS file_no
FROM sym GROUP BY repo, filePath
""",
    "calls": r"""
SELECT DISTINCT s.sym_key AS src, d.sym_key AS dst, s.repo AS repo
FROM lineitem a
JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
JOIN sym s ON s.sym_key = a.l_partkey
JOIN sym d ON d.sym_key = b.l_partkey
WHERE a.l_partkey <> b.l_partkey AND s.repo = d.repo
""",
    "commits": r"""
SELECT m.repo, m.path AS filePath, e.ts,
       concat(CASE WHEN e.event_id % 2 = 0 THEN 'User' ELSE 'user' END,
              CAST(e.user_id % 40 AS STRING), '@x.org') AS email
FROM events e JOIN mod m ON m.file_no = e.event_id % 50
""",
    "throws_direct": r"""
SELECT sym_key, repo, concat('E', CAST(communityId AS STRING)) AS errorType FROM sym WHERE sym_key % 7 = 0
""",
    "catches": r"""
SELECT sym_key, repo, concat('E', CAST(sym_key % 5 AS STRING)) AS errorType FROM sym WHERE sym_key % 5 = 1
""",
    "ext_services": r"""
SELECT 'main' AS repo, lower(n_name) AS name,
       CASE n_regionkey % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'grpc' WHEN 2 THEN 'amqp' ELSE 'graphql' END AS protocol
FROM nation
""",
    "calls_service": r"""
SELECT DISTINCT s.sym_key, s.repo, lower(n.n_name) AS service
FROM lineitem l JOIN supplier p ON p.s_suppkey = l.l_suppkey
JOIN nation n ON n.n_nationkey = p.s_nationkey
JOIN sym s ON s.sym_key = l.l_partkey
WHERE s.repo = 'main'
""",
    "docs": r"""
SELECT d.doc_id, s.sym_key, concat('services/', coalesce(d.source, 'none'), '/doc-', CAST(d.doc_id AS STRING), '.md') AS path,
       CASE d.doc_id % 4 WHEN 0 THEN 'adr' WHEN 1 THEN 'runbook' WHEN 2 THEN 'guide' ELSE 'bogus' END AS type,
       CASE d.doc_id % 5 WHEN 0 THEN 'draft' WHEN 1 THEN '' ELSE 'current' END AS status,
       CASE WHEN d.doc_id % 3 = 0 THEN 'main' END AS service,
       concat(coalesce(d.text, ''), chr(10), 'Call `', s.name, '` or `Missing', CAST(d.doc_id AS STRING),
              '`, never `promise` nor `Promise`.', chr(10), '[x](graph://symbol/', s.repo, '/', s.filePath, '#', s.name, ')',
              chr(10), '```js', chr(10), 'import { a } from ''./', replace(lower(p.p_brand), '#', '-'), '.js'';',
              chr(10), '```', chr(10)) AS body
FROM documents d CROSS JOIN (SELECT count(*) AS n FROM part) k
JOIN sym s ON s.sym_key = 1 + (d.doc_id + k.n - 1) % k.n JOIN part p ON p.p_partkey = s.sym_key
""",
    "governs": r"""
SELECT d.path AS doc_path, s.sym_key FROM docs d JOIN sym s ON s.sym_key = d.doc_id + 1 WHERE d.type = 'adr'
""",
    "sym_summaries": r"""
SELECT s.sym_key, s.repo, s.id AS symbolFqn, e.embedding, e.label,
       CASE WHEN e.vec_id % 3 = 0 THEN 'canonical' ELSE 'provisional' END AS tier,
       e.vec_id % 7 = 0 AS stale
FROM embeddings e JOIN sym s ON s.sym_key = e.vec_id
""",
}


def with_views(sql: str) -> str:
    """``sql`` behind all views as common table expressions."""
    views = ",\n".join(f"{name} AS ({text})" for name, text in VIEWS.items())
    lead = "WITH RECURSIVE " if sql.lstrip().upper().startswith("WITH RECURSIVE") else "WITH "
    rest = sql.lstrip()
    for word in ("WITH RECURSIVE", "WITH"):
        if rest.upper().startswith(word):
            return f"{lead}{views},\n{rest[len(word):]}"
    return f"{lead}{views}\n{rest}"


#: Tables that grow with the graph though their files stay small, by the views that join them: both sides are shuffled,
#: as what Spark would send to all tasks by a file's size is many times that size in memory.
SHUFFLED = {"calls": ["lineitem", "sym"], "calls_service": ["sym"], "docs": ["sym", "part"], "governs": ["sym"], "sym_summaries": ["sym"]}


class Graph:
    """Test tables and derived views as DataFrames, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            if name not in self._made:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            return self._made[name]
        if name not in VIEWS:
            raise AttributeError(name)
        if name not in self._made:
            words = set(re.findall(r"\w+", VIEWS[name]))
            for other in [*TABLES, *VIEWS]:
                if other in words and other != name:
                    table = getattr(self, other)
                    (table.hint("merge") if other in SHUFFLED.get(name, []) else table).createOrReplaceTempView(other)
            self._made[name] = self.spark.sql(VIEWS[name])
        return self._made[name]
