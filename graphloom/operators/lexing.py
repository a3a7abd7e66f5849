"""Source text taken apart into strings, templates, regular expressions, comments and code.

One pattern reads a whole text from its start, so that what begins in a string or a comment is never
taken for anything else, over lines too. Its repeated groups are possessive: they don't keep places to
return to, and so neither long literals nor long lines need the matcher's stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.arrays import let

FILE = ["repo", "filePath"]

#: A literal that isn't closed ends with its line or the text, so that it's read once.
SINGLE = r"'(?:[^'\\\n]++|\\.)*+(?:'|(?=\n)|\z)"
DOUBLE = r'"(?:[^"\\\n]++|\\.)*+(?:"|(?=\n)|\z)'
#: What may stand in braces, to a depth that code in templates has.
_inside = r"(?:[^{}'\"`]++)"
for _ in range(4):
    _inside = rf"(?:[^{{}}'\"`]++|{SINGLE}|{DOUBLE}|`(?:[^`\\]++|\\.)*+`|\{{{_inside}*+\}})"
HOLE = rf"\$\{{{_inside}*+\}}"
TEMPLATE = rf"`(?:[^`\\$]++|\\.|{HOLE}|\$)*+(?:`|\z)"
COMMENT = r"/\*.*?(?:\*/|\z)|//[^\n]*+"
#: A slash begins a regular expression only behind what can't end an operand.
REGEX = r"(?<=(?:[=(,:;!&|?{}\[+*%~^<>\n-]|\breturn|\btypeof|\bcase|^)[\x20\t]{0,20})/(?![*/])(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[a-z]*+"
LITERAL = rf"{SINGLE}|{DOUBLE}|{TEMPLATE}|{REGEX}"
#: Parts of a text: comments, literals, runs of plain code, and single marks that begin none of these.
PARTS = rf"(?s)({COMMENT}|{LITERAL}|[^'\"`/]++|.)"
#: All that comes before a comment.
BEFORE_COMMENT = rf"(?:{LITERAL}|[^'\"`/]++|/(?![*/])|['\"`])*+"


def _blank(c: Column) -> Column:
    """Spaces in place of all characters but line ends."""
    return F.regexp_replace(c, r"[^\n]", " ")


def _quoted(c: Column) -> Column:
    """A literal with its quotation marks, and blanks between."""
    n = F.char_length(c)
    last = F.substring(c, n, F.lit(1))
    return F.concat(F.substring(c, 1, 1), _blank(F.substring(c, F.lit(2), n - 2)), F.when(last.isin("'", '"', "`"), last).otherwise(_blank(last)))


def blanked(text: Column) -> Column:
    """The code of a text: comments, strings and regular expressions are blanks of the same length and lines.

    Quotation marks stay. Of a template only what is computed in it stays, without the braces.
    """
    parts = lambda t: F.regexp_extract_all(t, F.lit(PARTS), F.lit(1))
    is_comment = lambda p: p.startswith("//") | p.startswith("/*")
    is_literal = lambda p: (F.char_length(p) > 1) & (F.substring(p, 1, 1).isin("'", '"', "/"))

    def hole(p: Column) -> Column:
        inner = F.substring(p, F.lit(3), F.char_length(p) - 3)
        plain = F.transform(parts(inner), lambda q: F.when(is_comment(q), _blank(q)).when(is_literal(q) | ((F.char_length(q) > 1) & q.startswith("`")), _quoted(q)).otherwise(q))
        return F.concat(F.lit("  "), F.array_join(plain, ""), F.lit(" "))

    def template(p: Column) -> Column:
        pieces = F.regexp_extract_all(p, F.lit(rf"(?s)({HOLE}|\\.|[^$\\]++|.)"), F.lit(1))
        marked = F.transform(pieces, lambda q: F.when(q.startswith("${") & (F.char_length(q) > 2), hole(q)).otherwise(_blank(q)))
        return let(F.array_join(marked, ""), lambda m: F.concat(F.lit("`"), F.substring(m, F.lit(2), F.char_length(m) - 2), F.lit("`")))

    def one(p: Column) -> Column:
        return F.when(is_comment(p), _blank(p)).when((F.char_length(p) > 1) & p.startswith("`"), template(p)).when(is_literal(p), _quoted(p)).otherwise(p)

    return F.array_join(F.transform(parts(text), one), "")


def code_lines(files: DataFrame) -> DataFrame:
    """A row for each line of ``files`` (repo, filePath, text) by its number from 1: its ``code``."""
    return files.select(*FILE, F.posexplode(F.split(blanked(F.col("text")), "\n")).alias("at", "code")).select(*FILE, (F.col("at") + 1).alias("lineNo"), "code")


def comments(text: Column) -> Column:
    """Array of ``gap``, ``c``: each comment and what is between it and the last.

    A match begins where the last one ended, the last at the end of the text: nothing is read twice.
    """
    pattern = F.lit(rf"(?s)\G({BEFORE_COMMENT})({COMMENT}|\z)")
    found = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("c"))
    return F.filter(found, lambda x: x["c"] != "")
