"""URL filters: fixed rules by host and path, and rules mined from labelled URLs.

A fixed rule names a host, with all its subdomains, and the start of a path; the longest that
fits decides. For the other URLs, the combinations of URL tokens that stand often enough, and with
enough confidence, with the label ``block`` are rules. Tokens that are sure alone are found by
counting, and tokens that always stand together count as one; FP-growth finds the combinations of
what is left, and those go that hold a shorter rule that is as sure. A URL matches a mined rule if it has all its
tokens: rules are indexed by a hash of their rarest token, so a URL's tokens look up few
candidates, and these are checked in full. A URL that no rule blocks is allowed.

Only DataFrame functions and Spark's own FP-growth run on the executors. Up to ``max_rules`` mined
rules are indexed in a constant of the plan; more of them stay a table, joined with the distinct
token sets of the URLs by rarest token. None is dropped for its number.

Cases: host and path of a null URL or one without ``://`` are empty, no rule fits them and they
are allowed. A very long URL is read whole. Of fixed rules of one length the last by name decides.
Repeated rows give repeated results and count as often as they occur. Without labels, or without any mined rule,
only fixed rules block. An empty table gives no rows. Other columns of the input stay; columns
already called as the outputs are replaced.
"""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpointed, free_prefix, lower_ascii

BLOCK, ALLOW = "block", "allow"
LABEL = "label="
#: Slots of the inverted index.
SLOTS = 1024


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Params:
    """``min_count``: least number of labelled URLs that hold a combination, at any size; ``max_tokens``: of
    a rule; ``max_rules``: as many are indexed in the plan, more are joined."""

    min_count: int = 25
    min_confidence: float = 0.9
    max_tokens: int = 4
    max_rules: int = 500


def split_url(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, "^([^/?#]*)", 1))
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def fixed_rule(rules: list[Rule]) -> Column:
    """Name of the longest rule that fits ``host`` and ``path``, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


def tokens(url_col: str = "url") -> Column:
    """Distinct tokens: parent domains and words of the host, words of the path, query keys.

    Digits of a word become one ``0``, so that page numbers are alike.
    """
    word = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    tagged = lambda tag, words: F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(tag), word(F.lower(w))))
    query = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    domains = F.array(F.substring_index("host", ".", -1), F.substring_index("host", ".", -2))
    return F.array_distinct(F.concat(tagged("d:", domains), tagged("h:", F.split("host", "[.-]")), tagged("p:", F.split("path", "[/._-]")), tagged("q:", keys)))


#: Columns of mined rules.
RULES = "items array<string>, confidence double, support double"


@dataclass(frozen=True)
class Mined:
    """Tokens that, all in one URL, block it."""

    items: frozenset[str]
    confidence: float
    support: float


def _told_apart(rows: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """Sure tokens as rules, and ``rows`` with those tokens only that a longer rule may need.

    A token that is sure alone makes a longer rule with it superfluous, whatever its confidence.
    Of tokens that stand in the same rows, by count and two checksums over rows, the first stands
    for all, so that tokens that always come together aren't combined with each other. A token
    with too few blocked rows is in no rule.
    """
    each = rows.select("row", "label", F.explode("items").alias("token"))
    facts = checkpointed(each.groupBy("token").agg(F.count("*").alias("n"), F.count_if(F.col("label") == BLOCK).alias("blocked"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y")))
    facts = facts.where(F.col("blocked") >= params.min_count)
    sure = F.col("blocked") >= params.min_confidence * F.col("n")
    alone = facts.where(sure).select(F.array("token").alias("items"), (F.col("blocked") / F.col("n")).alias("confidence"), "blocked")
    rest = facts.where(~sure).groupBy("n", "blocked", "x", "y").agg(F.min("token").alias("token")).select("token")
    return alone, each.join(rest, "token").groupBy("row", "label").agg(F.collect_list("token").alias("items"))


def mined(labelled: DataFrame, params: Params = Params()) -> DataFrame:
    """Blocking rules from rows of ``items`` and ``label``: items, ascending, confidence and support."""
    rows = labelled.where(F.col("label").isNotNull() & (F.size("items") > 0)).select(F.array_distinct("items").alias("items"), "label")
    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    if n < params.min_count:
        return labelled.sparkSession.createDataFrame([], RULES)
    alone, rest = _told_apart(rows, params)
    alone = alone.select("items", "confidence", (F.col("blocked") / n).alias("support"))
    sets = checkpointed(rest.select(F.concat("items", F.array(F.concat(F.lit(LABEL), "label"))).alias("items")))
    left = sets.count()
    if left < params.min_count:
        return checkpointed(alone)
    # FP-growth rounds up: half a row less than the count asks for just as many
    found = FPGrowth(itemsCol="items", minSupport=(params.min_count - 0.5) / left, minConfidence=params.min_confidence).fit(sets).associationRules
    found = found.where((F.col("consequent") == F.array(F.lit(LABEL + BLOCK))) & (F.size("antecedent") <= params.max_tokens))
    found = checkpointed(found.select(F.array_sort("antecedent").alias("items"), "confidence", (F.col("support") * left / n).alias("support")))
    # a rule adds nothing to one that is a part of it and at least as sure
    parts = found.where(F.size("items") > 1).select("items", "confidence", F.explode(F.expr("sequence(1, shiftleft(1, size(items)) - 2)")).alias("mask"))
    parts = parts.select(F.col("items").alias("whole"), F.col("confidence").alias("sure"), F.expr("filter(items, (x, i) -> (shiftright(mask, i) & 1) = 1)").alias("items"))
    covered = parts.join(found, "items").where(F.col("confidence") >= F.col("sure")).select(F.col("whole").alias("items")).distinct()
    return checkpointed(alone.unionByName(found.join(covered, "items", "left_anti")))


def mine(labelled: DataFrame, params: Params = Params()) -> list[Mined]:
    """The rules of ``mined``, surest first, on the driver."""
    rules = mined(labelled, params).orderBy(F.desc("confidence"), F.desc("support"), F.size("items"), "items")
    return [Mined(frozenset(r["items"]), r["confidence"], r["support"]) for r in rules.collect()]


def slot(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(SLOTS)).cast("int")


def inverted_index(pages: DataFrame, rules: list[Mined]) -> Column:
    """An array of slots, each with the rules whose rarest token hashes to it, as a constant."""
    uses = Counter(t for r in rules for t in r.items)
    rarest = [(min(r.items, key=lambda t: (uses[t], t)), sorted(r.items)) for r in rules]
    slots: list[list[list[str]]] = [[] for _ in range(SLOTS)]
    if rarest:
        spark = pages.sparkSession
        at = spark.createDataFrame([(t, i) for i, (t, _) in enumerate(rarest)], "token string, rule int").select("rule", slot(F.col("token")).alias("slot")).collect()
        for r in at:
            slots[r["slot"]].append(rarest[r["rule"]][1])
    return F.from_json(F.lit(json.dumps(slots)), "array<array<array<string>>>")


def blocked_sets(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Those rows of ``sets``, distinct ``whole``, that have all tokens of a rule."""
    of = rules.select("items", F.explode("items").alias("token"))
    uses = of.groupBy("token").agg(F.count("*").alias("uses"))
    keyed = of.join(uses, "token").groupBy("items").agg(F.min(F.struct("uses", "token"))["token"].alias("token"))
    candidates = sets.select("whole", F.explode("whole").alias("token")).join(keyed, "token")
    return candidates.where(F.size(F.array_except("items", "whole")) == 0).select("whole").distinct()


def judge(pages: DataFrame, fixed: list[Rule], rules: list[Mined] | DataFrame, url_col: str = "url", params: Params = Params()) -> DataFrame:
    """``pages`` with host, path, ``rule`` and ``verdict``."""
    rows = split_url(pages, url_col).withColumn("rule", fixed_rule(fixed))
    verdict = reduce(lambda c, r: F.when(F.col("rule") == r.name, r.verdict).otherwise(c), fixed, F.lit(None).cast("string"))
    items, hit = (free_prefix(pages) + x for x in ("items", "hit"))
    if isinstance(rules, DataFrame):
        few = rules.limit(params.max_rules + 1).collect()
        if len(few) > params.max_rules:
            rows = rows.withColumn(items, tokens(url_col))
            hits = blocked_sets(rows.select(F.col(items).alias("whole")).distinct(), rules).select(F.col("whole").alias(items), F.lit(True).alias(hit))
            rows = rows.join(hits, items, "left")
            return rows.withColumn("verdict", F.coalesce(verdict, F.when(F.col(hit), BLOCK).otherwise(ALLOW))).drop(items, hit)
        rules = [Mined(frozenset(r["items"]), r["confidence"], r["support"]) for r in few]
    if not rules:
        return rows.withColumn("verdict", F.coalesce(verdict, F.lit(ALLOW)))
    index = inverted_index(pages, rules)
    rows = rows.withColumn(items, tokens(url_col))
    candidates = F.flatten(F.transform(items, lambda t: F.get(index, slot(t))))
    mined = F.exists(candidates, lambda r: F.size(F.array_except(r, F.col(items))) == 0)
    return rows.withColumn("verdict", F.coalesce(verdict, F.when(mined, BLOCK).otherwise(ALLOW))).drop(items)
