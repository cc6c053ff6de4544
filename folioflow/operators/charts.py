"""Chart payloads as aggregations: every operator takes a DataFrame and column names and returns one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions.values import leading_number, number

#: Top groups by value; ties go to the smaller category, so results don't depend on partitions.
TOP_BARS, TOP_SHARES = 20, 8


def bars(df: DataFrame, category: str, value: str, top: int = TOP_BARS) -> DataFrame:
    """(category, value): sums of a value by category, largest first; unreadable values count nothing, null categories go."""
    sums = df.where(F.col(category).isNotNull()).groupBy(F.col(category).alias("category"))
    return sums.agg(F.coalesce(F.sum(number(F.col(value))), F.lit(0.0)).alias("value")).orderBy(F.desc("value"), "category").limit(top)


def line(df: DataFrame, time: str, value: str) -> DataFrame:
    """(label, value): pairs in order of time; labels show days only if days differ or all is in one month."""
    pairs = df.select(F.col(time).cast("timestamp").alias("t"), number(F.col(value)).alias("value")).where("t is not null and value is not null")
    kinds = pairs.agg((F.min(F.dayofmonth("t")) != F.max(F.dayofmonth("t"))).alias("days"), (F.min(F.month("t")) == F.max(F.month("t"))).alias("one_month"))
    label = F.when(F.col("days") | F.col("one_month"), F.date_format("t", "yyyy-MM-dd")).otherwise(F.date_format("t", "yyyy-MM"))
    return pairs.join(F.broadcast(kinds)).select(label.alias("label"), "t", "value")  # kinds is one row


def shares(df: DataFrame, category: str, value: str, top: int = TOP_SHARES, other: bool = True) -> DataFrame:
    """(category, value): percentages of the total for the top groups, the rest together as Other. Nothing if the total is
    not positive."""
    sums = df.where(F.col(category).isNotNull() & number(F.col(value)).isNotNull()).groupBy(F.col(category).alias("category")).agg(F.sum(number(F.col(value))).alias("s"))
    total = sums.agg(F.sum("s").alias("total"), F.count("*").alias("groups"))
    best = sums.orderBy(F.desc("s"), "category").limit(top)
    part = best.join(F.broadcast(total)).where("total > 0").select("category", (100 * F.col("s") / F.col("total")).alias("value"), "groups")
    if not other:
        return part.select("category", "value")
    rest = part.groupBy("groups").agg((100 - F.sum("value")).alias("value")).where(F.col("groups") > top).select(F.lit("Other").alias("category"), "value")
    return part.select("category", "value").unionByName(rest)


def pie(df: DataFrame, category: str, value: str, top: int = TOP_SHARES) -> DataFrame:
    """(category, value, share): sums with unreadable values as 0 and null categories as N/A; shares to two places; no Other."""
    sums = df.groupBy(F.coalesce(F.col(category).cast("string"), F.lit("N/A")).alias("category")).agg(F.sum(leading_number(F.col(value), 0.0)).alias("value"))
    total = sums.agg(F.sum("value").alias("total"))
    best = sums.orderBy(F.desc("value"), "category").limit(top)
    return best.join(F.broadcast(total)).where("total <> 0").select("category", "value", F.round(100 * F.col("value") / F.col("total"), 2).alias("share"))


def heat_cards(df: DataFrame, category: str, value: str) -> DataFrame:
    """(category, value, scaled, band): sums scaled between the least and the largest, in five bands."""
    sums = df.where(number(F.col(value)).isNotNull()).groupBy(F.col(category).alias("category")).agg(F.sum(number(F.col(value))).alias("value"))
    ends = sums.agg(F.min("value").alias("low"), F.max("value").alias("high"))
    scaled = F.when(F.col("high") == F.col("low"), 0.5).otherwise((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")))
    band = F.when(F.col("scaled") <= 0.1, 1).when(F.col("scaled") <= 0.3, 2).when(F.col("scaled") <= 0.5, 3).when(F.col("scaled") <= 0.7, 4).otherwise(5)
    return sums.join(F.broadcast(ends)).withColumn("scaled", scaled).select("category", "value", "scaled", band.alias("band"))


def series(df: DataFrame, row: str, name: str, value: str, first: int = 20, bad: float | None = 0.0) -> DataFrame:
    """(row, name, value): the first rows as they stand."""
    rows = df.select(F.col(row).alias("row"), F.coalesce(F.col(name).cast("string"), F.lit("N/A")).alias("name"), leading_number(F.col(value), bad).alias("value"))
    return rows.orderBy("row").limit(first)


def scatter(df: DataFrame, row: str, name: str, x: str, y: str, first: int = 50) -> DataFrame:
    """(row, name, x, y, z): the first rows as points of one size."""
    rows = df.select(F.col(row).alias("row"), F.col(name).cast("string").alias("name"), leading_number(F.col(x), 0.0).alias("x"), leading_number(F.col(y), 0.0).alias("y"), F.lit(10).alias("z"))
    return rows.orderBy("row").limit(first)


def axis_domain(df: DataFrame, value: str) -> DataFrame:
    """(low, high): an axis that shows the values: padded if all are equal, zoomed if they hardly differ."""
    ends = df.agg(F.min(value).alias("a"), F.max(value).alias("b"))
    pad = F.greatest(F.abs(F.col("b")) * 0.01, F.lit(1.0))
    close = (F.col("b") - F.col("a")) / F.col("b") < 0.005
    low = F.when((F.col("a") == 0) & (F.col("b") == 0), 0.0).when(F.col("a") == F.col("b"), F.col("a") - pad).when(close, F.col("a") - (F.col("b") - F.col("a"))).otherwise(0.0)
    high = F.when((F.col("a") == 0) & (F.col("b") == 0), 1.0).when(F.col("a") == F.col("b"), F.col("b") + pad).when(close, F.col("b") + (F.col("b") - F.col("a"))).otherwise(F.col("b") * 1.05)
    return ends.select(low.alias("low"), high.alias("high"))


def projected(df: DataFrame, group: str, time: str, value: str, percent: float, steps: int) -> DataFrame:
    """(group, step, value): from each group's last real observation on, growing by percent a step."""
    last = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("group")).agg(F.max_by(value, time).alias("last"))
    step = F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")
    return last.select("group", "last", step).select("group", "step", (F.col("last") * F.pow(F.lit(1 + percent / 100), F.col("step"))).alias("value"))


def scenario(df: DataFrame, value: str, percent: float) -> DataFrame:
    return df.withColumn("scenario", F.col(value) * (1 + percent / 100))


def series_status(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, status): allNull, allZero or mixed."""
    status = F.when(F.count(value) == 0, "allNull").when(F.min(F.when(F.col(value) != 0, 0).otherwise(1)) == 1, "allZero").otherwise("mixed")
    return df.groupBy(F.col(group).alias("group")).agg(status.alias("status"))


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; a partial top-1 is taken before the shuffle."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def quantile_bands(df: DataFrame, columns: list[str], bands: int = 5) -> DataFrame:
    """(metric, value, band): each metric's values in equal bands between its least and largest value."""
    long = df.unpivot([], columns, "metric", "value").where("value is not null")
    ends = long.groupBy("metric").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    band = F.when(F.col("high") == F.col("low"), 1).otherwise(F.least(F.lit(bands), F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * bands).cast("int") + 1))
    return long.join(F.broadcast(ends), "metric").select("metric", "value", band.alias("band"))  # a row for each named column
