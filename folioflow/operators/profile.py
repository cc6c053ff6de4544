"""Profiles and cleaning of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.plans.lineage import cut

SUMMARY_WORDS = ("total", "sum", "subtotal", "sub total", "grand total")


def without_summary_rows(df: DataFrame, first: str) -> DataFrame:
    return df.where(~F.lower(F.trim(F.coalesce(F.col(first), F.lit("")))).isin(*SUMMARY_WORDS))


def quantiles(long: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, q): exact quantiles, interpolated between neighbours, of the values that are not null. Values are counted, put in
    ranges, and found by their rank: no task holds more than its range, whatever the size of a group."""
    counts = long.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    ranged = cut(counts.repartitionByRange(*keys, "_v").withColumn("_p", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "_p").agg(F.sum("_c").alias("_s"))  # a row for each range
    before = sums.select(*keys, "_p", (F.sum("_s").over(W.partitionBy(*keys).orderBy("_p")) - F.col("_s")).alias("_b"), F.sum("_s").over(W.partitionBy(*keys)).alias("_n"))
    within = ranged.withColumn("_w", F.sum("_c").over(W.partitionBy(*keys, "_p").orderBy("_v")))
    placed = within.join(F.broadcast(before), [*keys, "_p"]).withColumn("_to", F.col("_b") + F.col("_w"))  # as many rows as ranges
    facts = [F.max("_n").alias("_n")]
    for i, share in enumerate(shares):
        at = F.lit(share) * (F.col("_n") - 1)
        facts += [F.min(F.when(F.col("_to") > F.floor(at), F.col("_v"))).alias(f"_lo{i}"), F.min(F.when(F.col("_to") > F.ceil(at), F.col("_v"))).alias(f"_hi{i}")]
    found = placed.groupBy(*keys).agg(*facts)
    part = lambda s: F.lit(s) * (F.col("_n") - 1) - F.floor(F.lit(s) * (F.col("_n") - 1))
    each = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * part(s) for i, s in enumerate(shares)]
    return found.select(*keys, F.array(*each).alias("q"))


def column_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, non_null, min, max, mean, median, std) of numeric columns."""
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "column", "value")
    facts = long.groupBy("column").agg(F.count("value").alias("non_null"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    medians = quantiles(long, ["column"], "value", [0.5]).select("column", F.col("q")[0].alias("median"))
    return facts.join(F.broadcast(medians), "column", "left").select("column", "non_null", "min", "max", "mean", "median", "std")  # a row for each column


def without_outliers(df: DataFrame, columns: list[str], least_values: int = 10) -> DataFrame:
    """Values beyond 1.5 interquartile ranges become null, each column by its own quartiles; columns with few values stay."""
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "column", "value")
    found = quantiles(long, ["column"], "value", [0.25, 0.75])
    counts = long.groupBy("column").agg(F.count("value").alias("n")).where(F.col("n") > least_values)
    facts = counts.join(found, "column").agg(F.map_from_entries(F.collect_list(F.struct("column", "q"))).alias("_q"))
    out = df.join(F.broadcast(facts))  # one row with an entry for each column
    for c in columns:
        low, high = F.col("_q")[c][0], F.col("_q")[c][1]
        inside = F.col(c).between(low - 1.5 * (high - low), high + 1.5 * (high - low))
        out = out.withColumn(c, F.when(low.isNull() | inside, F.col(c)))
    return out.select(*df.columns)


def column_ratios(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled, unique): shares of rows that are not null, and of distinct values among these."""
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column", "value")
    each = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    full = F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0))
    return each.groupBy("column").agg((full / F.sum("n")).alias("filled"), (F.count("value") / full).alias("unique"))


def classified_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, class): year, categorical, numeric or date, from the shares of values that read as such; empty columns go."""
    return value_classes(df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column", "value"), [], "column")


def value_classes(long: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name, class) of columns given as long rows of keys, name and value (string)."""
    value = F.col("value")
    digits = F.regexp_replace(value, r"[^\d.\-]", "")
    reads = digits.rlike(r"^-?(\d+\.?\d*|\.\d+)$")
    share = lambda cond: F.avg(F.when(value.isNotNull(), cond.cast("double")))
    facts = long.groupBy(*keys, name).agg(
        F.count("value").alias("n"), F.count("*").alias("rows"), share(value.rlike(r"^(19|20)\d{2}$")).alias("years"), share(value.isin("true", "false", "True", "False")).alias("booleans"),
        F.sum(F.when(reads, 1).otherwise(0)).alias("numbers"), F.max(value.rlike("[a-zA-Z]")).alias("letters"),
        F.min(F.when(reads, digits.rlike(r"^\d+$"))).alias("only_digits"), F.avg(F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), 1.0).otherwise(0.0)).alias("dates"),
    )
    numeric = (F.col("numbers") / F.col("rows") > 0.7) & ~(F.col("letters") & F.col("only_digits"))
    kind = (
        F.when(F.coalesce(F.col(name).rlike(r"^(19|20)\d{2}$") | ((F.lower(name) == "year") & (F.col("years") > 0.8)), F.lit(False)), "year")
        .when(F.col("booleans") == 1, "categorical")
        .when(F.col("dates") > 0.8, "date")  # before numbers, as here a date's digits would read as one
        .when(numeric, "numeric")
        .otherwise("categorical")
    )
    return facts.where("n > 0").select(*keys, name, kind.alias("class"))


def dates(df: DataFrame, column: str, formats: tuple[str, ...] = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "yyyy-MM-dd HH:mm:ss")) -> DataFrame:
    """df with the column as dates if over half of it look like full dates and not over four fifths are months; values that
    no format reads become null. One pass decides; whatever it decides, the column's type is string or date by then."""
    value = F.trim(F.col(column))
    months = F.avg(F.when(value.rlike(r"^\d{4}-\d{2}$"), 1.0).otherwise(0.0))
    full = F.avg(F.when(value.rlike(r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"), 1.0).otherwise(0.0))
    facts = df.agg(months.alias("months"), full.alias("full")).first()
    if facts.full is None or facts.months > 0.8 or facts.full <= 0.5:
        return df
    return df.withColumn(column, F.coalesce(*(F.try_to_timestamp(value, F.lit(f)) for f in formats)).cast("date"))


def numeric_kinds(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, kind): long if every readable value is whole, double if not, string if none can be read."""
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column", "value")
    read = F.when(F.col("value").rlike(r"^\s*-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim("value").cast("double"))
    facts = long.groupBy("column").agg(F.count("value").alias("n"), F.count(read).alias("numbers"), F.min(read == F.floor(read)).alias("whole"))
    return facts.select("column", F.when((F.col("numbers") < F.col("n")) | (F.col("numbers") == 0), "string").when(F.col("whole"), "long").otherwise("double").alias("kind"))


def standard_name(name: str) -> str:
    """Lower case, blanks and hyphens as underscores, other punctuation out."""
    plain = name.strip().lower().replace(" ", "_").replace("-", "_")
    return "".join(c for c in plain if c.isalnum() or c == "_")


def distinct_names(names: list[str | None]) -> list[str]:
    """Blank names become Unnamed; repeats get _1, _2 and so on."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        name = "Unnamed" if name is None or not str(name).strip() else str(name)
        n = seen.get(name, -1) + 1
        seen[name] = n
        out.append(name if not n else f"{name}_{n}")
    return out


def without_empty_columns(df: DataFrame) -> DataFrame:
    """Drops columns that hold nothing, found in one pass."""
    counts = df.agg(*(F.count(f"`{c}`").alias(c) for c in df.columns)).first()
    return df.select(*(f"`{c}`" for c in df.columns if counts[c]))


def without_empty_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows that hold something: neither null nor blank text in all the columns."""
    filled = [F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) != "" for c in columns or df.columns]
    return df.where(F.greatest(*filled) if len(filled) > 1 else filled[0])


def aligned_rows(rows: DataFrame, group: str, values: str, headers: DataFrame, names: str) -> tuple[DataFrame, DataFrame]:
    """(rows, headers) of the same width by group: as many names as the widest row has values, further ones called column_<number>;
    short rows are padded with nulls. values, names: arrays; headers has a row for each group."""
    width = rows.groupBy(group).agg(F.max(F.size(values)).alias("_width"))
    heads = headers.join(width, group).withColumn("_own", F.size(names))
    more = F.when(F.col("_width") > F.col("_own"), F.transform(F.sequence(F.col("_own") + 1, F.col("_width")), lambda i: F.concat(F.lit("column_"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    heads = heads.withColumn(names, F.slice(F.concat(names, more), F.lit(1), F.col("_width")))
    padded = rows.join(width, group).withColumn(values, F.concat(values, F.array_repeat(F.lit(None).cast("string"), F.col("_width") - F.size(values)))).drop("_width")
    return padded, heads.drop("_width", "_own")


def value_kind(value: Column, kind: str) -> Column:
    """boolean, number, string or, for null and anything else, unknown; kind: the column's type."""
    name = "boolean" if kind == "boolean" else "string" if kind == "string" else "number" if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal") else "unknown"
    return F.when(value.isNotNull(), name).otherwise("unknown")


def first_row_kinds(df: DataFrame, order: str) -> DataFrame:
    """(column, kind): what the first row's values are; columns are called col_0 and so on."""
    kinds = [F.struct(F.lit(f"col_{i}").alias("column"), value_kind(F.col(f"`{n}`"), t).alias("kind")) for i, (n, t) in enumerate(df.dtypes)]
    return df.orderBy(order).limit(1).select(F.inline(F.array(*kinds)))


def melted_years(df: DataFrame, key: str, least: int = 2) -> DataFrame:
    """(key, Year, Value): columns named by years as rows, without nulls."""
    years = [c for c in df.columns if len(c) == 4 and c.isdigit() and c[:2] in ("19", "20")]
    if len(years) < least:
        return df
    return df.select(key, *(F.col(f"`{y}`").cast("double").alias(y) for y in years)).unpivot([key], years, "Year", "Value").where("Value is not null")


def merged_sheets(sheets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Sheets with the same columns become one, with the name of each row's sheet, without repeated rows."""
    groups: dict[tuple, list[str]] = {}
    for name, df in sheets.items():
        groups.setdefault(tuple(sorted(df.columns)), []).append(name)
    out = {}
    for names in groups.values():
        merged = sheets[names[0]].withColumn("source_sheet", F.lit(names[0]))
        for name in names[1:]:
            merged = merged.unionByName(sheets[name].withColumn("source_sheet", F.lit(name)))
        out["_".join(names)] = merged.dropDuplicates() if len(names) > 1 else sheets[names[0]]
    return out
