"""Scalar expressions over cells, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(value: Column) -> Column:
    """A cell as a number: currency signs, thousands commas, stars and spaces are dropped; otherwise null."""
    bare = F.regexp_replace(value.cast("string"), r"[$,*\s]", "")
    return F.when(bare.rlike(r"^-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.cast("double"))


def leading_number(value: Column, bad: float | None = None) -> Column:
    """The number that a cell starts with once all but digits, dots and minus signs are gone: `1.2.3` is 1.2."""
    bare = F.regexp_replace(value.cast("string"), r"[^\d.\-]", "")
    found = F.regexp_extract(bare, r"^-?(\d+\.?\d*|\.\d+)", 0)
    out = F.when(found != "", found.cast("double"))
    return out if bad is None else F.coalesce(out, F.lit(bad))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def column_letters(index: Column) -> Column:
    """0 is A, 25 is Z, 26 is AA; up to three letters."""
    one = lambda x: F.char(F.lit(65) + x)
    low, past = index % 26, index - 702
    return (
        F.when(index < 26, one(low))
        .when(index < 702, F.concat(one(F.floor(index / 26) - 1), one(low)))
        .otherwise(F.concat(one(F.floor(past / 676)), one(F.floor(past / 26) % 26), one(low)))
    )


def a1_range(r0: Column, r1: Column, c0: Column, c1: Column) -> Column:
    """Half-open, zero-based rows and columns as a spreadsheet range."""
    return F.concat(column_letters(c0), (r0 + 1).cast("string"), F.lit(":"), column_letters(c1 - 1), r1.cast("string"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or empty."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


def parent(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")


def short_number(value: Column) -> Column:
    """1234 is 1.2k, 5600000 is 5.6M."""
    text = lambda x: F.format_string("%.1f", x)
    return F.when(F.abs(value) >= 1e6, F.concat(text(value / 1e6), F.lit("M"))).when(F.abs(value) >= 1e3, F.concat(text(value / 1e3), F.lit("k"))).otherwise(text(value))


def percentage(value: Column, places: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{places}f", value * 100.0), F.lit("%"))


def fixed(value: Column, places: int = 2) -> Column:
    return F.format_string(f"%.{places}f", value * 1.0)


def iso_time(time: Column) -> Column:
    """A UTC timestamp as ISO text with milliseconds; the session's zone is to be UTC."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def epoch_milliseconds(time: Column) -> Column:
    return F.unix_millis(time.cast("timestamp"))


# Parts of a header, in any case, that tell of a column with projected figures.
PROJECTION_WORDS = ("FP", "Proyección", "Proyeccion", "Forecast", "Estimate", "Estimado", "Projection", "Projected", "Capacidad", "Plan", "Target", "Objetivo")


def header_kind(header: Column) -> Column:
    """year, projection or other."""
    words = F.array(*(F.lit(w.lower()) for w in PROJECTION_WORDS))
    return F.when(header.rlike(r"^(19|20)\d{2}$"), "year").when(F.exists(words, lambda w: F.contains(F.lower(header), w)), "projection").otherwise("other")


def relation_type(name: Column) -> Column:
    """A relationship type that can be a label: upper case, other characters as underscores, never starting with a digit."""
    bare = F.regexp_replace(F.upper(name), "[^A-Z0-9_]", "_")
    return F.when(bare.rlike("^[A-Z_]"), bare).otherwise(F.concat(F.lit("REL_"), bare))


def normal_name(name: Column) -> Column:
    """Lower case, punctuation out, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", ""), r"\s+", " "))


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal normal names; the length ratio if one holds the other and the ratio is over a half; else six tenths of
    edit similarity and four of the overlap of their words."""
    return plain_similarity(normal_name(a), normal_name(b))


def plain_similarity(x: Column, y: Column) -> Column:
    """name_similarity() of normal names."""
    short, long_ = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    ratio = short / long_
    holds = F.contains(x, y) | F.contains(y, x)
    p, q = F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))
    jaccard = F.size(F.array_intersect(p, q)) / F.size(F.array_union(p, q))
    return F.when(x == y, F.lit(1.0)).when(holds & (ratio > 0.5), ratio).otherwise(0.6 * (1 - F.levenshtein(x, y) / long_) + 0.4 * jaccard)


def same_name(a: Column, b: Column, least: float = 0.85) -> Column:
    return same_plain(normal_name(a), normal_name(b), least)


def same_plain(x: Column, y: Column, least: float = 0.85) -> Column:
    """same_name() of normal names."""
    ratio = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y))
    return (x == y) | ((F.contains(x, y) | F.contains(y, x)) & (ratio > 0.5)) | (plain_similarity(x, y) >= least)
