"""Quality of documents by weak supervision: rules vote or abstain, their accuracies are estimated without labels.

A rule looks at counts of a text and votes good (1), bad (-1) or abstains (0). Filters that ask for
every rule to pass lose clean documents that one crude rule misjudges. Here each rule has two
accuracies instead: how often it votes good on good documents and bad on bad ones, when it votes.
Expectation-maximisation finds them and the share of good documents from the votes alone: it
weighs each pattern of votes by the probability of being good, and sets the accuracies to what
those weights say, in a fixed number of rounds. Documents that the base filter drops are no part of it:
they are decided, and so many of one kind that they would be taken for all that is bad. A document's quality is that probability for its
own votes; abstaining says nothing. A vote never counts against its own meaning.

Counts are DataFrame functions on each row; patterns are counted by partial sums, and there are at
most ``3 ** rules`` of them however many documents there are. A round is one aggregation of the
patterns to one row of accuracies.

Words that stand in a repeated window are found by hashes of all windows first; only windows whose hash comes
twice are compared as text, by sorting. That takes n log n steps for n words.

Cases: a null text counts as empty; every rule abstains on a text without words, and the base
filter (too few words) drops it. Repeated rows and ids are judged row by row, alike for equal
texts. A very long text is read whole and takes memory in proportion. With an empty table the
accuracies stay as they began and there are no rows. Other columns, null or not and whatever their
names, play no part; ``judged`` keeps them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpointed, free_prefix
from graphloom.llm.spans import let

GAP = r"\x20\x09-\x0D"
#: Words without a letter.
LETTERLESS = rf"(?<![^{GAP}])[^{GAP}\p{{L}}]++(?![^{GAP}])"
#: Words of letters, hyphens or apostrophes within, and one mark at the end.
PLAIN = rf"(?<![^{GAP}])[\p{{L}}\p{{M}}]++(?:['’-][\p{{L}}\p{{M}}]++)*+[.,;:!?]?+(?![^{GAP}])"
#: Three and more characters in a row that are neither letters nor digits.
RUN = rf"[^{GAP}\p{{L}}\p{{M}}\p{{N}}]{{3,}}+"


@dataclass(frozen=True)
class Rule:
    """``bad`` and ``good``: conditions on counts, in SQL; where neither holds the rule abstains."""

    name: str
    bad: str
    good: str


#: Counts: see ``measures``. Ratios are written as products, so that they are exact.
RULES = [
    Rule("length", "n_words < 20", "n_words BETWEEN 50 AND 100000"),
    Rule("word_length", "n_words > 0 AND (2 * word_chars < 5 * n_words OR word_chars > 12 * n_words)", "3 * n_words <= word_chars AND word_chars <= 10 * n_words AND n_words >= 20"),
    Rule("symbols", "n_words > 0 AND 10 * n_symbols >= n_words", "n_words >= 20 AND 50 * n_symbols <= n_words"),
    Rule("equal_lines", "n_lines >= 3 AND 10 * n_dup_lines >= 3 * n_lines", "n_lines >= 3 AND 20 * n_dup_lines <= n_lines"),
    Rule("repeated_words", "n_words >= 16 AND 10 * n_repeat_words >= 3 * n_words", "n_words >= 16 AND 50 * n_repeat_words <= n_words"),
    Rule("letters", "n_words > 0 AND 10 * n_letterless >= 2 * n_words", "n_words >= 20 AND 20 * n_letterless <= n_words"),
    Rule("line_ends", "n_lines >= 3 AND 10 * n_ended_lines < n_lines", "n_lines >= 1 AND 10 * n_ended_lines >= 8 * n_lines"),
    Rule("vocabulary", "n_words BETWEEN 50 AND 5000 AND 5 * n_distinct < n_words", "n_words BETWEEN 20 AND 5000 AND 2 * n_distinct >= n_words"),
    Rule("capitals", "n_letters >= 20 AND 10 * n_capitals >= 4 * n_letters", "n_letters >= 20 AND 10 * n_capitals <= n_letters"),
    Rule("plain_words", "n_words >= 20 AND 10 * n_plain < 6 * n_words", "n_words >= 20 AND 10 * n_plain >= 8 * n_words"),
    Rule("runs", "n_words >= 10 AND 10 * n_runs >= n_words", "n_words >= 20 AND 50 * n_runs <= n_words"),
    Rule("exclamations", "n_words >= 5 AND 10 * n_exclaims >= 3 * n_words", "n_words >= 20 AND 20 * n_exclaims <= n_words"),
]


@dataclass(frozen=True)
class Params:
    """``rounds`` of expectation-maximisation; where it begins: the share of good documents, and a rule's accuracies.

    ``weight``: documents that the first accuracies count for; ``surest``: greatest accuracy, one
    less it is the least; ``least``: probability of being good from which a document is kept.
    """

    rounds: int = 25
    share: float = 0.8
    on_good: float = 0.95
    on_bad: float = 0.6
    weight: float = 2.0
    surest: float = 0.9999
    least: float = 0.5
    window: int = 8


@dataclass(frozen=True)
class Model:
    """Share of good documents, and each rule's accuracy on good and on bad ones."""

    share: float
    on_good: list[float]
    on_bad: list[float]


def _neighbours(a: Column, field: str) -> Column:
    """Items of a sorted array of structs whose field equals that of an item next to it."""
    same = lambda x, i: F.coalesce(F.get(a, i)[field] == x[field], F.lit(False))
    return F.filter(a, lambda x, i: same(x, i - 1) | same(x, i + 1))


def repeated_words(words: Column, window: int) -> Column:
    """How many words stand in windows of so many words that come twice or more."""
    part = lambda w, i: F.slice(w, i + 1, F.lit(window))

    def covered(starts: Column) -> Column:
        new = F.transform(starts, lambda s, k: F.least(F.lit(window), F.coalesce(F.get(starts, k + 1) - s, F.lit(window))))
        return F.aggregate(new, F.lit(0), lambda a, x: a + x)

    def compared(w: Column, hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        texts = lambda a: F.sort_array(F.transform(_neighbours(a, "h"), lambda x: F.struct(F.array_join(part(w, x["i"]), " ").alias("text"), x["i"].alias("i"))))
        starts = lambda a: F.sort_array(F.transform(_neighbours(a, "text"), lambda x: x["i"]))
        return let(by_hash, lambda a: let(texts(a), lambda b: let(starts(b), covered)))

    def counted(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(part(w, i)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(compared(w, h)))

    return F.when(F.size(words) > window, let(words, counted)).otherwise(F.lit(0))


def measures(text: Column, window: int = 8) -> Column:
    """A struct of counts (long) of a text; lines and line counts are of lines with a word."""
    text = F.coalesce(text, F.lit(""))
    without = lambda t, pattern: F.char_length(F.regexp_replace(t, pattern, ""))
    count = lambda t, chars: F.char_length(t) - without(t, f"[{chars}]+")

    def of(t: Column, w: Column, lines: Column) -> Column:
        counts = {
            "n_words": F.size(w),
            "word_chars": F.char_length(F.array_join(w, "")),
            "n_symbols": count(t, "#*$%&|<>"),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeated_words(w, window),
            "n_letterless": F.regexp_count(t, F.lit(LETTERLESS)),
            "n_plain": F.regexp_count(t, F.lit(PLAIN)),
            "n_runs": F.regexp_count(t, F.lit(RUN)),
            "n_ended_lines": F.size(F.filter(lines, lambda x: x.rlike(rf"[.!?][{GAP}]*\z"))),
            "n_distinct": F.size(F.array_distinct(w)),
            "n_letters": without(t, r"\P{L}+"),
            "n_capitals": without(t, r"\P{Lu}+"),
            "n_exclaims": count(t, "!?"),
        }
        return F.struct(*[c.cast("long").alias(name) for name, c in counts.items()])

    words = lambda t: F.array_remove(F.split(t, f"[{GAP}]+"), "")
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{GAP}]"))
    return let(text, lambda t: let(words(t), lambda w: let(lines(t), lambda x: of(t, w, x))))


def measured(docs: DataFrame, text: str = "text", params: Params = Params()) -> DataFrame:
    """``docs`` without texts, with a column each for all counts, votes as an array, and ``base_failed``."""
    rows = docs.withColumn(text, measures(F.col(text), params.window)).select(*[c for c in docs.columns if c != text], f"{text}.*")
    votes = [F.when(F.expr(r.bad), F.lit(-1)).when(F.expr(r.good), F.lit(1)).otherwise(F.lit(0)) for r in RULES]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.withColumn("votes", F.array(*votes)).withColumn("base_failed", failed)


def quality(votes: Column, model: Model) -> Column:
    """Probability that a document with these votes is good."""
    odds = F.lit(math.log(model.share / (1 - model.share)))
    for i, (g, b) in enumerate(zip(model.on_good, model.on_bad, strict=True)):
        vote = F.element_at(votes, i + 1)
        odds = odds + F.when(vote == 1, F.lit(math.log(g / (1 - b)))).when(vote == -1, F.lit(math.log((1 - g) / b))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def fit(voted: DataFrame, params: Params = Params()) -> Model:
    """Accuracies from the ``votes`` of all documents that pass the base filter."""
    patterns = checkpointed(voted.where(~F.col("base_failed")).groupBy("votes").agg(F.count("*").alias("n")))
    model = Model(params.share, [params.on_good] * len(RULES), [params.on_bad] * len(RULES))
    sums = []
    for i in range(len(RULES)):
        vote = F.element_at("votes", i + 1)
        for name, weight in (("good", F.col("good")), ("bad", F.col("n") - F.col("good"))):
            sums += [F.sum(F.when(vote == v, weight).otherwise(0.0)).alias(f"{name}_{k}_{i}") for k, v in (("right", 1 if name == "good" else -1), ("wrong", -1 if name == "good" else 1))]
    for _ in range(params.rounds):
        got = patterns.withColumn("good", F.col("n") * quality(F.col("votes"), model)).agg(F.sum("n").alias("n"), F.sum("good").alias("good"), *sums).first()
        if not got["n"]:
            break
        held = lambda x: min(max(x, 1 - params.surest), params.surest)
        rate = lambda name, start, i: held((got[f"{name}_right_{i}"] + params.weight * start) / (got[f"{name}_right_{i}"] + got[f"{name}_wrong_{i}"] + params.weight))
        on_good = [rate("good", params.on_good, i) for i in range(len(RULES))]
        on_bad = [max(rate("bad", params.on_bad, i), 1 - g) for i, g in enumerate(on_good)]
        model = Model(held((got["good"] + params.weight * params.share) / (got["n"] + params.weight)), on_good, on_bad)
    return model


def kept(votes: Column, base_failed: Column, model: Model, params: Params = Params()) -> Column:
    return ~base_failed & (quality(votes, model) >= params.least)


def judged(docs: DataFrame, text: str = "text", params: Params = Params()) -> DataFrame:
    """``docs`` with the votes' ``quality`` and whether each is ``kept``; a name that is taken gets a free prefix."""
    p = free_prefix(docs)
    found = measured(docs.select(F.struct(*docs.columns).alias(p + "row"), F.col(text).alias(p + "text")), p + "text", params)
    model = fit(found, params)
    taken = {c.lower() for c in docs.columns}
    name = lambda c: p + c if c in taken else c
    return found.select(f"{p}row.*", quality(F.col("votes"), model).alias(name("quality")), kept(F.col("votes"), F.col("base_failed"), model, params).alias(name("kept")))
