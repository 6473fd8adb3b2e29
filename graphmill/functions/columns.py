"""Scalar functions as Column expressions, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_norm(c: Column) -> Column:
    """Lower case, runs of non-word characters and underscores to one blank."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9À-ɏ]+", " "))


def id_norm(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def shingles(c: Column, k: int = 3) -> Column:
    """Distinct character k-shingles; a shorter text is its own."""
    n = F.length(c)
    return F.when(n <= k, F.array(c)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(k)))))


def entropy(c: Column) -> Column:
    """Shannon entropy in bits for each character."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.size(chars).cast("double")
    share = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / n)
    return F.aggregate(F.array_sort(share), F.lit(0.0), lambda s, p: s - p * F.log2(p))


def url_path(c: Column) -> Column:
    """A URL's path without host, query and fragment; numbers and {parameters} become *; one slash at most in a row, none at the end."""
    p = F.regexp_replace(F.regexp_replace(c, "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    p = F.regexp_replace(p, "/(\\d+|\\{[^}]*\\}|:[a-z_]+)", "/*")
    p = F.regexp_replace(F.regexp_replace(p, "/+", "/"), "/$", "")
    return F.when(p == "", "/").otherwise(p)


def token_estimate(c: Column) -> Column:
    return F.when(F.length(c) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(c) / 4)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is empty or zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity; 1 where a vector is empty or zero."""
    return 1 - cosine(a, b)


def age_days(now: Column, ts: Column) -> Column:
    """Whole days of age, never negative."""
    return F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 86_400_000_000))


def decay(days: Column, rate: Column, uses: Column, drift: Column) -> Column:
    """Exponential decay with a floor of 0.2, resistance by use (a fifth for every five uses, four fifths at most) and a penalty for drift over 0.4 (0.3 at most)."""
    resistance = F.least(F.lit(0.8), 0.2 * F.floor(uses / 5))
    base = F.exp(-rate * (1 - resistance) * days)
    penalty = F.when(drift > 0.4, F.least(F.lit(0.3), drift - 0.4)).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.2), base - penalty), 4)


def edge_weight(confidence: Column, injected: Column) -> Column:
    return (1 + 2 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))) * F.when(injected, 1.5).otherwise(1.0)


def effort_minutes(c: Column) -> Column:
    """Minutes of an effort such as 1d2h30min; a day has eight hours."""
    num = lambda unit: F.coalesce(F.regexp_extract(c, f"(\\d+){unit}", 1).try_cast("int"), F.lit(0))
    return num("d") * 480 + num("h") * 60 + num("min")


def rating_letter(c: Column) -> Column:
    return F.element_at(F.create_map(*(x for i, v in enumerate("ABCDE", 1) for x in (F.lit(i), F.lit(v)))), c)


def confidence_class(c: Column) -> Column:
    return F.when(c >= 0.8, "EXTRACTED").when(c >= 0.4, "INFERRED").otherwise("AMBIGUOUS")


def visible_text(c: Column) -> Column:
    """Distinct texts between tags and in placeholder-like attributes, joined with a bar."""
    found = F.concat(F.regexp_extract_all(c, F.lit(">([^<>{}]{3,})<"), 1), F.regexp_extract_all(c, F.lit("(?:placeholder|title|alt|aria-label)=\"([^\"]+)\""), 1))
    return F.array_join(F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")), " | ")
