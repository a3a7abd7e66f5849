"""Personal data: regular expressions propose spans, checksums confirm them, context scores them.

Kinds with a strict form (email, ip, card, phone) are reported whenever they validate. Looser
kinds are reported if their score reaches a threshold: a prior of the kind, more if a checksum
confirms it, and more if a word that goes with the kind stands near. All of it is DataFrame
functions; a pattern of which a text lacks a needed character isn't searched.

The patterns of the strict kinds are written so that no long text makes them slow: a look-behind
lets a match begin only where a run of its characters does (or where the last match ended), and
repeated groups are possessive. They match what their plain forms match.

Cases: a null text counts as empty and has no spans. A very long text, or one with very many
matches, takes time in proportion (but for a logarithm). Spans that begin alike are in the order of the
kinds. Repeated rows give repeated results. An empty table gives no rows. Other columns of the input
stay, whatever their names; columns already called as the outputs are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import free_prefix
from graphloom.llm.spans import as_spans, located, n_of, ordered, written

STRICT = ["email", "ip", "card", "phone"]
LOOSE = ["iban", "card_short", "local_phone", "national_id"]

#: Patterns of the strict kinds and a character without which there is no match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


@dataclass(frozen=True)
class Loose:
    """``prior``: score of a match; ``checked``: added if the checksum holds; ``context``: words
    one of which, within ``WINDOW`` code points, adds ``near``."""

    pattern: str
    prior: float
    context: str
    checked: float = 0.0
    near: float = 0.4


WINDOW = 40
THRESHOLD = 0.5
LOOSE_KINDS = {
    "iban": Loose(r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", 0.1, r"iban|account|bank|konto|compte|cuenta", 0.6, 0.2),
    "card_short": Loose(r"(?<![0-9])(?<![0-9][\x20-])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![\x20-]?[0-9])", 0.1, r"card|amex|credit|karte|carte|tarjeta", 0.3, 0.4),
    "local_phone": Loose(r"(?<![0-9+)(-])(?<!\+[0-9]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])", 0.5, r"phone|tel|call|fax|mobil|cell", 0.0, 0.3),
    "national_id": Loose(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.5, r"ssn|social|security|insurance", 0.0, 0.4),
}


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 1, doubled(d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether a bank account code of capitals and digits passes its check."""
    moved = F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: (F.when(c.rlike("[0-9]"), a * 10).otherwise(a * 100) + value(c)) % 97
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def is_ip(match: Column) -> Column:
    """Four parts of at most 255, with any number of leading zeros."""
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))


def _matches(text: Column, pattern: str, needed: str | None = None) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found if needed is None else F.when(F.contains(text, F.lit(needed)), found).otherwise(F.array().cast("array<string>"))


def _score(kind: str, x: Column) -> Column:
    loose = LOOSE_KINDS[kind]
    score = F.lit(loose.prior)
    if loose.checked:
        score += F.when(mod97(x["match"]) if kind == "iban" else luhn(digits(x["match"])), loose.checked).otherwise(0.0)
    return score + F.when(F.lower(x["near"]).rlike(loose.context), loose.near).otherwise(0.0)


def _scored(kind: str, matches: Column) -> Column:
    return F.transform(matches, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), _score(kind, x).alias("score")))


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``strict``, ``loose`` (arrays of spans) and ``scores`` (of the loose spans)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    patterns = {"email": (EMAIL, "@"), "ip": (IP, "."), "card": (CARD, None), "phone": (PHONE, "+")} | {k: (v.pattern, None) for k, v in LOOSE_KINDS.items()}
    # each step is a projection of its own, so that no search is repeated for a later use
    p = free_prefix(docs)
    matches, places, spans = ({k: f"{p}{step}_{k}" for k in patterns} for step in ("matches", "places", "spans"))
    rows = docs.withColumns({matches[k]: _matches(text, *v) for k, v in patterns.items()})
    rows = rows.withColumns({places[k]: located(text, patterns[k][0], F.col(matches[k]), WINDOW if k in LOOSE_KINDS else 0) for k in patterns})
    count = lambda x: F.length(digits(x["match"]))
    keep = {"email": None, "ip": lambda x: is_ip(x["match"]), "card": lambda x: luhn(digits(x["match"])), "phone": lambda x: count(x).between(8, 15)}
    rows = rows.withColumns({spans[k]: as_spans(F.col(places[k]), k, keep[k]) for k in STRICT})
    rows = rows.withColumns({spans[k]: F.filter(_scored(k, F.col(places[k])), lambda x: x["score"] >= THRESHOLD - 1e-9) for k in LOOSE})
    strict = ordered(F.concat(*[F.col(spans[k]) for k in STRICT]), STRICT, start_first=False)
    loose = F.concat(*[F.col(spans[k]) for k in LOOSE])
    out = rows.withColumns({"strict": strict, "loose": ordered(F.transform(loose, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))), LOOSE, start_first=False), "scores": F.transform(loose, lambda x: x["score"])})
    return out.drop(*matches.values(), *places.values(), *spans.values())


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the hash of the strict spans, and all spans, of each document."""
    counts = [n_of("strict", k).alias(f"n_{k}") for k in STRICT]
    base = written(F.col("strict"))
    return found.select(F.col(id_col).alias("doc_id"), *counts, F.sha2(base, 256).alias("base_sha256"), written(F.concat("strict", "loose")).alias("spans"))
