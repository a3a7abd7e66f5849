"""Set operations behind the summarising of symbols and communities."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending_communities(members: DataFrame, fresh: DataFrame) -> DataFrame:
    """Communities without a fresh summary, with a score of how much they are worth one.

    ``members`` has repo, communityId, pageRank, fanIn, isPublicApi, changeFrequency, tier;
    ``fresh`` the keys of communities that need none. Weights are fixed values.
    """
    zero = lambda c: F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    score = 0.4 * zero("pageRank") + 0.3 * zero("fanIn") + 0.2 * zero("isPublicApi") + 0.1 * zero("changeFrequency") - 1.0 * F.avg(F.when(F.col("tier") == "canonical", 1.0).otherwise(0.0))
    rows = members.where("communityId IS NOT NULL").join(fresh, ["repo", "communityId"], "left_anti")
    return rows.groupBy("repo", "communityId").agg(F.count("*").alias("size"), score.alias("score"))


def focal_set(members: DataFrame, most: int = 10) -> DataFrame:
    """The first members of each community by PageRank, and all its bridges."""
    order = Window.partitionBy("repo", "communityId").orderBy(F.desc("pageRank"), "sym_key")
    return members.withColumn("at", F.row_number().over(order)).where((F.col("at") <= most) | (F.col("role") == "bridge"))


def canonical(page_rank: Column, public: Column, role: Column, least: float = 0.05) -> Column:
    """Whether a symbol is to have a canonical summary."""
    return (page_rank >= least) | public | (role == "bridge")


def validate(assertions: DataFrame, facts: DataFrame) -> DataFrame:
    """``status`` of each summary from its asserted facts (``sym_key``, ``kind``, ``value``).

    All hold: validated; some: partial; none, or nothing asserted: unvalidated.
    """
    hits = assertions.join(facts.select("sym_key", "kind", "value").distinct().withColumn("ok", F.lit(1)), ["sym_key", "kind", "value"], "left")
    rows = hits.groupBy("sym_key").agg(F.count("*").alias("total"), F.count("ok").alias("held"))
    status = F.when(F.col("held") == F.col("total"), "validated").when(F.col("held") > 0, "partial").otherwise("unvalidated")
    return rows.withColumn("status", status)


def token_cost(chars_in: Column, chars_out: Column) -> Column:
    """Cost of a model call by fixed prices of 1000 tokens of four characters."""
    return F.ceil(chars_in / 4) / 1000 * 0.0003 + F.ceil(chars_out / 4) / 1000 * 0.0015


def within_ceiling(calls: DataFrame, run: str, order: str, cost: str, ceiling: float) -> DataFrame:
    """The calls of each run that start before its spending reaches the ceiling."""
    before = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("spent", F.coalesce(F.sum(cost).over(before), F.lit(0.0))).where(F.col("spent") < ceiling)


def cluster_coverage(members: DataFrame, claimed: DataFrame) -> DataFrame:
    """Coverage of each community: no more than its members with a summary allow."""
    actual = members.groupBy("repo", "communityId").agg((100.0 * F.count("tier") / F.count("*")).alias("actual"))
    return actual.join(claimed, ["repo", "communityId"]).withColumn("coveragePct", F.least("claimed", "actual"))


def community(symbols: DataFrame, summaries: DataFrame) -> DataFrame:
    """Members of each community by PageRank: ``at``, the symbol's columns, whether it has a summary, and of what tier."""
    tiers = summaries.select(F.col("symbolFqn").alias("id"), "tier").groupBy("id").agg(F.min("tier").alias("tier"))
    order = Window.partitionBy("repo", "communityId").orderBy(F.desc_nulls_last("pageRank"), "id")
    rows = symbols.where("communityId IS NOT NULL").join(tiers, "id", "left")
    return rows.withColumns({"at": F.row_number().over(order), "hasSummary": F.col("tier").isNotNull()})


def node_details(symbols: DataFrame, throws: DataFrame, calls_service: DataFrame, reads_config: DataFrame, tests: DataFrame) -> DataFrame:
    """Symbols with what they throw, read and call, each a list in order, and whether a test reaches them."""
    listed = lambda df, value, name: df.groupBy(F.col("symbol").alias("id")).agg(F.array_sort(F.collect_set(value)).alias(name))
    out = symbols
    for df, value, name in ((throws, "errorType", "thrownTypes"), (calls_service, "service", "services"), (reads_config, "key", "configKeys")):
        out = out.join(listed(df, value, name), "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    tested = tests.select(F.col("symbol").alias("id")).distinct().withColumn("t", F.lit(True))
    return out.join(tested, "id", "left").withColumn("testCoverage", F.coalesce("t", F.lit(False))).drop("t")


def existing(summaries: DataFrame, key: str) -> DataFrame:
    """The summary of a symbol."""
    return summaries.where(F.col("symbolFqn") == key)


#: The longest texts and lists of a summary.
MOST = {"purpose": 150, "details": 600, "sideEffects": 300, "examples": 400}
MOST_TAGS = 10
PAYLOAD = "purpose string, details string, sideEffects string, examples string, semanticTags array<string>"


def payload(answer: Column) -> Column:
    """A model's answer as the fields of a summary, cut to their lengths; null if it is no object."""
    p = F.from_json(answer, PAYLOAD)
    fields = [F.substring(F.coalesce(p[k], F.lit("")), 1, n).alias(k) for k, n in MOST.items()]
    tags = F.slice(F.coalesce(p["semanticTags"], F.array().cast("array<string>")), 1, MOST_TAGS).alias("semanticTags")
    return F.when(p.isNotNull() & answer.rlike(r"^\s*\{"), F.struct(*fields, tags))


def written(summaries: DataFrame, new: DataFrame) -> DataFrame:
    """``summaries`` with the new ones in place of those of their symbols, cut to length, fresh."""
    rows = new.withColumns({"purpose": F.substring("purpose", 1, MOST["purpose"]), "semanticTags": F.slice("semanticTags", 1, MOST_TAGS), "stale": F.lit(False)})
    last = rows.groupBy("symbolFqn").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "symbolFqn"]), F.struct("generatedAt", "purpose")).alias("r")).select("symbolFqn", "r.*")
    kept = summaries.join(last.select("symbolFqn"), "symbolFqn", "left_anti")
    return kept.unionByName(last, allowMissingColumns=True).select(*summaries.columns)


def in_turn(pending: DataFrame) -> DataFrame:
    """Communities in the order in which they are to be summarised: ``turn``, by score, then by key.

    The order is over all communities, which are few per repository, and so is one sort.
    """
    return pending.withColumn("turn", F.row_number().over(Window.orderBy(F.desc("score"), "repo", "communityId")))


def run(members: DataFrame, complete: Callable[[str, str], str], most_focal: int = 10) -> DataFrame:
    """Summaries of the given communities' members: symbolFqn, tier, the payload's fields, ``tries``.

    ``members`` has id, sym_key, repo, communityId, pageRank, isPublicApi, role, tier (null or that
    of a summary), prompt. Focal members get a canonical summary if they deserve one, else a
    provisional one; others a provisional one unless they have a canonical one. ``complete``
    takes prompt and tier and runs in the tasks; what gives no payload is asked once more.
    """
    focal = focal_set(members.withColumn("role", F.coalesce("role", F.lit("core"))), most_focal).select("id", F.lit(True).alias("focal"))
    rows = members.withColumnRenamed("tier", "had").join(focal.hint("merge"), "id", "left")  # as many as symbols: not sent to the driver
    wanted = canonical(F.coalesce("pageRank", F.lit(0.0)), F.coalesce("isPublicApi", F.lit(False)), F.coalesce("role", F.lit("core")))
    rows = rows.withColumn("tier", F.when(F.coalesce("focal", F.lit(False)) & wanted, "canonical").otherwise("provisional"))
    rows = rows.where(F.coalesce("focal", F.lit(False)) | ~F.col("had").eqNullSafe("canonical")).select(F.col("id").alias("symbolFqn"), "tier", "prompt")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first = [complete(p, t) for p, t in zip(batch["prompt"], batch["tier"], strict=True)]
            sound = [_is_object(a) for a in first]
            again = [a if ok else complete(p, t) for a, ok, p, t in zip(first, sound, batch["prompt"], batch["tier"], strict=True)]
            yield pd.DataFrame({"symbolFqn": batch["symbolFqn"], "tier": batch["tier"], "answer": pd.Series(again, dtype=object), "tries": [1 if ok else 2 for ok in sound]})

    answers = rows.mapInPandas(ask, "symbolFqn string, tier string, answer string, tries int")
    return answers.select("symbolFqn", "tier", "tries", payload(F.col("answer")).alias("p")).where("p IS NOT NULL").select("symbolFqn", "tier", "tries", "p.*")


def _is_object(answer: str | None) -> bool:
    try:
        return isinstance(json.loads(answer), dict)
    except (TypeError, ValueError):
        return False


def log_events(events: DataFrame, path: str) -> None:
    """Appends a run's events to its log, a line of JSON each."""
    events.write.mode("append").json(path)
