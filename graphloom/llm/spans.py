"""Spans of regular expressions in a text, as columns: no Python runs on the executors.

A span is a struct of ``kind``, ``start`` and ``end`` (code points, end exclusive). Spark gives
the matches of a pattern but not their places; those follow from the lengths of the matches and
of the pieces between them. All here takes n log n steps for n spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Of each place the values up to there, merged; ``merge`` skips a null on its left.

    Each round merges what lies twice as far back, so the rounds are the logarithm of the size.
    """
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    return F.aggregate(rounds, values, lambda acc, k: F.transform(acc, lambda x, i: merge(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)), x)))


def located(text: Column, pattern: str, found: Column, around: int = 0) -> Column:
    """Array of ``start, end, match, near`` for ``found``, all matches of ``pattern``.

    ``near``: the text before and behind a match, up to ``around`` code points each and no
    further than the neighbouring matches.
    """
    pieces = F.split(text, pattern, -1)
    near = lambda p, i, i_pieces: F.concat(F.right(p, F.lit(around)), F.lit(" "), F.left(F.get(i_pieces, i + 1), F.lit(around))) if around else F.lit("")
    empty = F.array().cast("array<struct<start:int,end:int,match:string,near:string>>")

    def places(p: Column) -> Column:
        step = F.transform(found, lambda m, i: F.char_length(F.get(p, i)) + F.char_length(m))
        each = lambda ends: F.transform(found, lambda m, i: F.struct((F.get(ends, i) - F.char_length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("match"), near(F.get(p, i), i, p).alias("near")))
        return let(running(step, lambda a, b: F.coalesce(a, F.lit(0)) + b), each)

    return F.when(F.size(found) > 0, let(pieces, places)).otherwise(empty)


def as_spans(matches: Column, kind: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans of one kind from :func:`located`, of the matches to keep."""
    kept = matches if keep is None else F.filter(matches, keep)
    return F.transform(kept, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def ordered(spans: Column, kinds: list[str], start_first: bool) -> Column:
    """Spans by start, then by the kind's place in ``kinds``, or the other way round."""
    place = lambda k: F.array_position(F.array(*[F.lit(x) for x in kinds]), k).cast("int")
    key = lambda x: [x["start"], place(x["kind"])] if start_first else [place(x["kind"]), x["start"]]
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key(x))], x["end"].alias("end"), x.alias("s"))))
    return F.transform(keyed, lambda x: x["s"])


def n_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with each span as its kind in brackets; those that overlap as one, by the first's kind.

    ``spans`` ascend by start. The text is taken apart once, whatever the number of spans.
    """

    def built(ends: Column) -> Column:
        reached = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        part = lambda chars, a, b: F.array_join(F.slice(chars, a + 1, F.greatest(b - a, F.lit(0))), "")
        gap = lambda chars: F.transform(spans, lambda s, i: F.when(s["start"] >= reached(i), F.concat(part(chars, reached(i), s["start"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(""))
        return let(F.split(text, ""), lambda chars: F.concat(F.array_join(gap(chars), ""), part(chars, F.element_at(ends, -1), F.size(chars))))

    ends = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    return F.when(F.size(spans) > 0, let(ends, built)).otherwise(text)
