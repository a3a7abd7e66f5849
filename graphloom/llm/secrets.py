"""Secret scans with linking of credentials that come in several parts.

Strong spans (an assignment to a secret's name, an access key id, a long hexadecimal run) are
reported wherever they stand. Weak candidates are parts that mean little alone: an identity
(user, client or account id), a secret without a telling name, an endpoint with a scheme. They
are reported only where complementary parts stand within the same scope, a window of code
points: an identity next to a secret, a secret next to an identity, an endpoint next to both.

The link is an interval join of each document's parts with themselves, as a merge: parts in order
of their places, and of each the last and the next identity, secret and strong span, as running
maxima and minima over the array. So a document's parts are sorted once and never paired, and no
row leaves its partition. No Python runs on the executors.

Cases: a null text counts as empty and has no spans; redaction leaves it null. Repeated rows give
repeated results. A weak candidate that overlaps a strong span is dropped; of parts that begin at
the same place each counts for the others. A very long text, or one with very many parts, takes time
in proportion (but for a logarithm). An empty table gives no rows. ``scan`` reads no other columns; ``redacted``
keeps them all, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import free_prefix
from graphloom.llm.spans import SPAN, as_spans, let, located, n_of, ordered, replaced, running, written

STRONG = ["assign", "access", "hex"]
WEAK = ["identity", "bare_secret", "endpoint"]
#: Roles that a strong span plays for the weak ones around it.
IDENTITIES, SECRETS = ("access", "identity"), ("assign", "hex", "bare_secret")

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
IDENTITY = r"""(?i)\b(?:client_?id|user_?(?:name|id)?|login|account_?(?:name|id)?|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,64}"""
BARE_SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{0,63}[0-9])(?=[A-Za-z0-9+/_-]{0,63}[A-Z])(?=[A-Za-z0-9+/_-]{0,63}[a-z])[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"\b[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._~:@%-]{3,}"


@dataclass(frozen=True)
class Params:
    """``scope``: how far apart, in code points between their starts, parts are of one credential."""

    scope: int = 240


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _together(spans: Column, scope: int) -> Column:
    """The weak ones of ``spans``, which ascend by start, that overlap no strong one and have what they need near."""

    def facts(x: Column) -> Column:
        role = lambda kinds: F.when(x["kind"].isin(*kinds), x["start"])
        strong = x["kind"].isin(*STRONG)
        return F.struct(role(IDENTITIES).alias("identity"), role(SECRETS).alias("secret"), F.when(strong, x["start"]).alias("start"), F.when(strong, x["end"]).alias("end"))

    each = lambda f: lambda a, b: F.struct(*[f(a[n], b[n]).alias(n) for n in ("identity", "secret", "start", "end")])
    near = lambda x, last, next_, role: (F.coalesce(x["start"] - last[role], F.lit(scope + 1)) <= scope) | (F.coalesce(next_[role] - x["start"], F.lit(scope + 1)) <= scope)

    def wanted(x: Column, last: Column, next_: Column) -> Column:
        apart = (F.coalesce(last["end"], F.lit(0)) <= x["start"]) & (F.coalesce(next_["start"], F.lit(2**31 - 1)) >= x["end"])
        identity, secret = near(x, last, next_, "identity"), near(x, last, next_, "secret")
        return apart & F.when(x["kind"] == "identity", secret).when(x["kind"] == "bare_secret", identity).when(x["kind"] == "endpoint", identity & secret).otherwise(False)

    def chosen(before: Column, behind: Column) -> Column:
        marked = F.transform(spans, lambda x, i: F.struct(x.alias("s"), wanted(x, F.get(before, i), F.get(behind, F.size(spans) - 1 - i)).alias("ok")))
        return F.transform(F.filter(marked, lambda m: m["ok"]), lambda m: m["s"])

    last = running(F.transform(spans, facts), each(F.greatest))
    next_ = running(F.transform(F.reverse(spans), facts), each(F.least))
    return let(last, lambda before: let(next_, lambda behind: chosen(before, behind)))


def find(docs: DataFrame, params: Params = Params(), text_col: str = "text", strong_out: str = "strong", linked_out: str = "linked") -> DataFrame:
    """``docs`` with two arrays of spans: the strong ones and the linked weak ones."""
    p = free_prefix(docs)
    col = lambda name: F.col(p + name)
    none = F.array().cast("array<string>")
    named = F.exists(F.array(*[F.lit(x) for x in ("password", "passwd", "secret", "token", "apikey", "api_key")]), lambda w: F.contains(col("lower"), w))
    rows = docs.withColumn(p + "text", F.coalesce(F.col(text_col), F.lit("")))
    rows = rows.withColumn(p + "lower", F.lower(col("text")))
    text = col("text")
    rows = rows.withColumns({
        p + "assign": F.when(named, _all(text, ASSIGN)).otherwise(none),
        p + "value": F.when(named, _all(text, ASSIGN, 2)).otherwise(none),
        p + "access": F.when(F.contains(text, F.lit("AKIA")), _all(text, ACCESS)).otherwise(none),
        p + "hex": _all(text, HEX),
        p + "identity": F.when(text.rlike("[:=]"), _all(text, IDENTITY)).otherwise(none),
        p + "bare_secret": _all(text, BARE_SECRET),
        p + "endpoint": F.when(F.contains(text, F.lit("://")), _all(text, ENDPOINT)).otherwise(none),
    })
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "identity": IDENTITY, "bare_secret": BARE_SECRET, "endpoint": ENDPOINT}
    rows = rows.withColumns({f"{p}at_{k}": located(text, v, col(k)) for k, v in patterns.items()})
    long_value = F.transform(F.filter(F.arrays_zip(col("at_assign").alias("l"), col("value").alias("v")), lambda x: F.length(x["v"]) >= 12), lambda x: x["l"])
    strong = F.concat(as_spans(long_value, "assign"), as_spans(col("at_access"), "access"), as_spans(col("at_hex"), "hex"))
    weak = F.concat(*[as_spans(col(f"at_{k}"), k) for k in WEAK])
    rows = rows.withColumns({p + "strong": ordered(strong, STRONG, start_first=True), p + "weak": weak})
    # an identity, secret or endpoint alone can't be linked
    worth = (F.size(col("weak")) > 0) & (F.size(col("weak")) + F.size(col("strong")) > 1)
    rows = rows.withColumn(p + "all", F.when(worth, ordered(F.concat(col("strong"), col("weak")), STRONG + WEAK, start_first=True)))
    linked = F.when(col("all").isNotNull(), _together(col("all"), params.scope)).otherwise(F.array().cast(f"array<{SPAN}>"))
    rows = rows.withColumn(p + "linked", linked)
    own = {c for c in rows.columns if c.startswith(p)} - {strong_out, linked_out}
    return rows.withColumns({strong_out: col("strong"), linked_out: col("linked")}).drop(*own)


def scan(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, ``strong`` and ``linked`` (arrays of spans)."""
    return find(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), params).drop("text")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the strong spans, and all spans, of each document."""
    counts = [n_of("strong", k).alias(f"n_{k}") for k in STRONG]
    return found.select("doc_id", *counts, F.sha2(written(F.col("strong")), 256).alias("base_sha256"), written(F.concat("strong", "linked")).alias("spans"))


def redacted(docs: DataFrame, params: Params = Params(), text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with each reported span replaced by its kind in brackets, and the new length.

    Overlapping spans are replaced as one, by the kind of the first.
    """
    p = free_prefix(docs)
    rows = find(docs, params, text_col, p + "strong", p + "linked")
    rows = rows.withColumn(p + "spans", ordered(F.concat(p + "strong", p + "linked"), STRONG + WEAK, start_first=True))
    rows = rows.withColumn(p + "new", F.when(F.size(p + "spans") > 0, replaced(F.col(text_col), F.col(p + "spans"))).otherwise(F.col(text_col)))
    if size_col in docs.columns:
        size = F.char_length(p + "new").cast(docs.schema[size_col].dataType)
        rows = rows.withColumn(size_col, F.when(F.size(p + "spans") > 0, size).otherwise(F.col(size_col)))
    return rows.withColumn(text_col, F.col(p + "new")).select(*docs.columns)
