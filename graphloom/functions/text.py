"""Text functions as columns."""

from __future__ import annotations

import posixpath
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def slugify_ascii(name: Column) -> Column:
    """A slug of a name without accents: words by ``-``, one plural ``s`` dropped."""
    s = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9\s-]", ""), r"\s+", "-")
    s = F.regexp_replace(F.regexp_replace(s, "-+", "-"), "^-|-$", "")
    return F.when((F.length(s) > 2) & s.endswith("s") & ~s.endswith("ss"), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)


@F.pandas_udf(T.StringType())
def without_accents(names: pd.Series) -> pd.Series:
    """NFKD without its combining marks; Spark has no such function."""
    strip = lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return names.map(strip)


def slugify(name: Column) -> Column:
    """As :func:`slugify_ascii`, for names with accents."""
    return slugify_ascii(without_accents(name))


@F.pandas_udf(T.StringType())
def joined_path(file_path: pd.Series, spec: pd.Series) -> pd.Series:
    """The path of a relative import, from the importing file's folder."""
    one = lambda f, s: None if f is None or s is None else posixpath.normpath(posixpath.join(posixpath.dirname(f), s))
    return pd.Series([one(f, s) for f, s in zip(file_path, spec, strict=True)], dtype=object)


def package_name(spec: Column) -> Column:
    """``@scope/pkg`` or the first segment of an external import."""
    return F.regexp_extract(spec, "^(@[^/]+/[^/]+|[^/]+)", 1)


def line_range(text: Column, start: Column, end: Column, most: int | None = None) -> Column:
    """Lines ``start`` to ``end`` (from 1, inclusive), at most so many."""
    n = end - start + 1
    return F.array_join(F.slice(F.split(text, "\n"), start, F.least(n, F.lit(most)) if most else n), "\n")


def strip_markdown(body: Column) -> Column:
    """Text without comments, fenced blocks and the signs of markdown."""
    s = F.regexp_replace(body, r"(?s)<!--.*?-->", "")
    s = F.regexp_replace(s, r"(?s)```.*?```", "")
    s = F.regexp_replace(s, r"(?m)^#{1,6}\s+", "")
    s = F.regexp_replace(s, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    s = F.regexp_replace(s, r"\[([^\]]+)\]\([^)]*\)", "$1")
    s = F.regexp_replace(s, r"`([^`]+)`", "$1")
    s = F.regexp_replace(s, r"(\*\*|__)(.+?)\1", "$2")
    s = F.regexp_replace(s, r"(\*|_)([^\s*_](?:[^*_]*[^\s*_])?)\1", "$2")
    s = F.regexp_replace(s, r"(?m)^\s*[-*+]\s+", "")
    s = F.regexp_replace(s, r"(?m)^>\s?", "")
    return F.trim(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def strip_html(html: Column) -> Column:
    """Text of a page: without comments, scripts, styles and tags."""
    s = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?s)<script[^>]*>.*?</script>", " ")
    s = F.regexp_replace(s, r"(?s)<style[^>]*>.*?</style>", " ")
    s = F.regexp_replace(s, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(s, r"[ \t\r\n]+", " "))


def fqn_part(fqn: Column, part: str) -> Column:
    """``repo``, ``filePath`` or ``name`` of ``repo:filePath#name``; empty if it isn't one."""
    return F.regexp_extract(fqn, "^([^:]*):(.*)#([^#]*)$", {"repo": 1, "filePath": 2, "name": 3}[part])


def semver(version: Column) -> Column:
    """Numbers of a version, three at least, without what follows a ``-``; comparable."""
    parts = F.transform(F.split(F.split(version, "-")[0], r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return F.concat(parts, F.array_repeat(F.lit(0), F.greatest(F.lit(0), 3 - F.size(parts))))


def cosine(a: Column, b: Column) -> Column:
    """0 if the lengths differ or one has no norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def floats_from_base64(encoded: pd.Series) -> pd.Series:
    """A vector from little-endian 32-bit floats in base64."""
    import base64

    import numpy as np

    return encoded.map(lambda s: None if s is None else np.frombuffer(base64.b64decode(s), "<f4"))


@F.pandas_udf(T.StringType())
def floats_to_base64(vectors: pd.Series) -> pd.Series:
    import base64

    import numpy as np

    return vectors.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode())


def clipped(text: Column, most: int) -> Column:
    """A text of at most so many characters, the last three dots if it was longer."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def name_similarity(name: Column, query: Column) -> Column:
    """1 for the same name (in any case), else one less the edit distance over the longer length."""
    a, b = F.lower(name), F.lower(query)
    return F.when(a == b, 1.0).otherwise(1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))
