"""Tables inside loosely filled sheets. A sheet is a long table of cells: file, sheet, row, col, value (string)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions.values import a1_range, number
from folioflow.operators.profile import SUMMARY_WORDS, value_classes
from folioflow.plans.lineage import cut

# Words that speak for a header, and cells that stand for nothing.
HEADER_WORDS = ("id", "name", "date", "value", "total", "sum", "category", "type", "status", "descripción", "fecha", "nombre", "código")
PLACEHOLDERS = ("n/a", "nan", "-", "--", "tbd", "pendiente", "no aplica", "na")
_KEYS = ["file", "sheet"]
#: Rows of a sheet whose cells are labelled together.
BAND_ROWS = 50_000


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For positions 0 to n - 1 tied in pairs (a, b): the smallest position that each one can reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _islands(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """For filled cells in order of row and column: the position of the first cell of each one's island."""
    side = np.flatnonzero((row[1:] == row[:-1]) & (col[1:] == col[:-1] + 1))
    width = int(col.max(initial=0)) + 1
    place = row.astype(np.int64) * width + col
    above = np.minimum(np.searchsorted(place, place - width), len(place) - 1)
    down = np.flatnonzero(place[above] == place - width)
    return _smallest(len(row), np.concatenate([side, above[down]]), np.concatenate([side + 1, down]))


def blocks(cells: DataFrame, band_rows: int = BAND_ROWS) -> DataFrame:
    """cells with block, the number of the island of neighbouring filled cells (up, down, left, right) that they are in, in order
    of the islands' first cells.

    Sheets are cut into bands of rows, so that none makes a large task; islands are found in each band, and those that touch
    across the seams of bands, which are few, are joined sheet by sheet.
    """

    def label(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("col", "ascending")])
        row, col = (table[c].to_numpy() for c in ("row", "col"))
        first = _islands(row - row.min(), col)
        return table.append_column("r", pa.array(row[first])).append_column("c", pa.array(col[first]))

    def join(table: pa.Table) -> pa.Table:
        ends = np.array([table[c].to_numpy() for c in ("r1", "c1", "r2", "c2")])
        pairs = np.concatenate([ends[:2].T, ends[2:].T])
        every, at = np.unique(pairs, axis=0, return_inverse=True)
        at = at.ravel()
        root = every[_smallest(len(every), at[: len(table)], at[len(table) :])]
        out = {"file": [table["file"][0].as_py()] * len(every), "sheet": [table["sheet"][0].as_py()] * len(every), "r": every[:, 0], "c": every[:, 1], "r0": root[:, 0], "c0": root[:, 1]}
        return pa.table({k: pa.array(v, pa.string() if k in _KEYS else pa.int32()) for k, v in out.items()})

    filled = cells.where("value is not null and value <> ''").select(*_KEYS, "row", "col", "value", F.floor(F.col("row") / band_rows).cast("int").alias("band"))
    kinds = {"row": "int", "col": "int", "value": "string", "band": "int", "r": "int", "c": "int"}
    labelled = filled.groupBy(*_KEYS, "band").applyInArrow(label, "file string, sheet string, " + ", ".join(f"{k} {v}" for k, v in kinds.items()))
    labelled = cut(labelled)
    seam = F.col("row") % band_rows
    upper = labelled.where(seam == band_rows - 1).select(*_KEYS, (F.col("row") + 1).alias("row"), "col", F.col("r").alias("r1"), F.col("c").alias("c1"))
    lower = labelled.where(seam == 0).select(*_KEYS, "row", "col", F.col("r").alias("r2"), F.col("c").alias("c2"))
    ties = upper.join(lower, [*_KEYS, "row", "col"]).select(*_KEYS, "r1", "c1", "r2", "c2").distinct()
    roots = ties.groupBy(*_KEYS).applyInArrow(join, "file string, sheet string, r int, c int, r0 int, c0 int")
    islands = labelled.select(*_KEYS, "r", "c").distinct().join(roots, [*_KEYS, "r", "c"], "left")
    islands = islands.withColumn("block", (F.dense_rank().over(W.partitionBy(*_KEYS).orderBy(F.coalesce("r0", "r"), F.coalesce("c0", "c"))) - 1).cast("int"))
    return labelled.join(islands.select(*_KEYS, "r", "c", "block"), [*_KEYS, "r", "c"]).select(*_KEYS, "row", "col", "value", "block")


def block_bounds(labelled: DataFrame, min_rows: int = 2, min_columns: int = 2, least_density: float = 0.25) -> DataFrame:
    """(file, sheet, block, r0, r1, c0, c1, density, range): blocks that are large and full enough to be tables."""
    bounds = labelled.groupBy(*_KEYS, "block").agg(F.min("row").alias("r0"), (F.max("row") + 1).alias("r1"), F.min("col").alias("c0"), (F.max("col") + 1).alias("c1"), F.count("*").alias("n"))
    rows, columns = F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")
    out = bounds.withColumn("density", F.col("n") / (rows * columns)).where((rows >= min_rows) & (columns >= min_columns) & (F.col("density") >= least_density)).drop("n")
    return out.withColumn("range", a1_range(F.col("r0"), F.col("r1"), F.col("c0"), F.col("c1")))


def header_scores(cells: DataFrame, keys: list[str], rows_checked: int = 20) -> DataFrame:
    """(keys, row, score): how much each of the first rows looks like a header. cells: keys, row (from 0), col, value (null
    where empty); a cell counts as a number if it reads as one."""
    value = F.trim("value")
    number = value.rlike(r"^-?[\d,]*\.?\d+%?$")
    first = F.min_by(F.lower(value), "col")
    facts = cells.where(F.col("row") < rows_checked).groupBy(*keys, "row").agg(
        F.count("*").alias("cells"), F.count("value").alias("filled"), F.sum(F.when(number, 1).otherwise(0)).alias("numbers"),
        F.sum(F.when(F.lower(value).isin(*PLACEHOLDERS), 1).otherwise(0)).alias("blanks"), first.alias("first"),
        F.max(F.when(F.lower(value).rlike("|".join(HEADER_WORDS)), 1).otherwise(0)).alias("hint"),
        F.sum(F.when(value.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & (F.length(value) < 25), 1).otherwise(0)).alias("names"),
    )
    order = W.partitionBy(*keys).orderBy("row")
    facts = facts.withColumn("texts", F.col("filled") - F.col("numbers")).withColumn("next_filled", F.lead("filled").over(order)).withColumn("next_numbers", F.lead("numbers").over(order))
    full, text, wide = F.col("filled") / F.col("cells"), F.col("texts") / F.col("filled"), F.col("cells") > 3
    next_number = F.col("next_numbers") / F.col("next_filled")
    score = (
        F.when(full > 0.7, full * 1.5).when((full < 0.4) & wide, F.when(F.col("texts") > 0, -1.0).otherwise(-3.0)).otherwise(0.0)
        + F.when(text > 0.8, text * 5).when(text > 0.6, text * 3).when((text < 0.3) & wide, -4.0).otherwise(0.0)
        + F.when(1 - text > 0.8, -5.0).otherwise(0.0)
        + F.when(F.coalesce(F.col("next_filled"), F.lit(0)) == 0, 0.0).when((text > 0.7) & (next_number > 0.6), 3.0).when((1 - text > 0.7) & (1 - next_number > 0.6), -2.0).otherwise(0.0)
        + F.when(F.col("first").isin(*SUMMARY_WORDS), -6.0).otherwise(0.0)
        + F.greatest(F.lit(0.0), 1.0 - F.col("row") * 0.4)
        + F.col("hint")
        + F.col("names") / F.col("cells") * 3
        - F.col("blanks") / F.col("filled") * 2.5
    )
    return facts.select(*keys, "row", F.when(F.col("filled") == 0, -100.0).otherwise(score).alias("score"))


def header_rows(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, header): the best row, or the earlier of the best two if their scores are close."""
    ranked = scores.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "row"))).where("_n <= 2")
    two = ranked.groupBy(*keys).agg(F.max_by("row", -F.col("_n")).alias("a"), F.max("score").alias("best"), F.max_by("row", "_n").alias("b"), F.min("score").alias("second"), F.count("*").alias("n"))
    gap = F.col("best") - F.col("second")
    close = (F.col("n") == 2) & (F.col("best") > -5) & F.when(F.col("best") > 0, gap / F.col("best") < 0.1).otherwise(gap < 1)
    return two.select(*keys, F.when(close, F.least("a", "b")).otherwise(F.col("a")).alias("header"))


def header_names(cells: DataFrame, headers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, col, name): the header row's cells; where one is empty, the cell above."""
    own = cells.join(headers, keys).where(F.col("row").isin(F.col("header")) | (F.col("row") == F.col("header") - 1))
    at = lambda cond: F.max(F.when(cond, F.nullif(F.trim("value"), F.lit(""))))
    return own.groupBy(*keys, "col").agg(F.coalesce(at(F.col("row") == F.col("header")), at(F.col("row") < F.col("header"))).alias("name"))


def column_islands(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, island, c0, c1): runs of columns that hold something; empty columns part them."""
    used = cells.where("value is not null and value <> ''").select(*keys, "col").distinct()
    island = F.col("col") - F.row_number().over(W.partitionBy(*keys).orderBy("col"))
    return used.withColumn("island", island).groupBy(*keys, "island").agg(F.min("col").alias("c0"), (F.max("col") + 1).alias("c1"))


def first_rows(df: DataFrame, order: list[str], cap: int = 1000) -> DataFrame:
    """The first rows in a total order, with how many there are and whether some are left out."""
    total = df.agg(F.count("*").alias("total_rows"))
    return df.orderBy(*order).limit(cap).join(F.broadcast(total)).withColumn("is_truncated", F.col("total_rows") > cap)  # total is one row


def described_tables(cells: DataFrame, min_rows: int = 2, min_columns: int = 2) -> DataFrame:
    """(file, sheet, block, range, header, col, name, class, filled, low, high, mean): every column of every table that the
    sheets hold. Tables are found, their header rows scored and their columns classified in one plan over all files."""
    keys = [*_KEYS, "block"]
    labelled = blocks(cells)
    bounds = block_bounds(labelled, min_rows, min_columns)
    # all places of a block, at most four times its filled cells, as less dense blocks are no tables
    places = bounds.select(*keys, "r0", "c0", "c1", F.explode(F.sequence("r0", F.col("r1") - 1)).alias("row")).select("*", F.explode(F.sequence("c0", F.col("c1") - 1)).alias("col"))
    grid = places.join(labelled, [*keys, "row", "col"], "left").select(*keys, (F.col("row") - F.col("r0")).alias("row"), (F.col("col") - F.col("c0")).alias("col"), "value")
    headers = header_rows(header_scores(grid, keys), keys)
    names = header_names(grid, headers, keys)
    data = grid.join(headers, keys).where(F.col("row") > F.col("header")).join(names, [*keys, "col"]).withColumn("label", F.coalesce("name", F.concat(F.lit("column_"), F.col("col").cast("string"))))
    classes = value_classes(data, [*keys, "header", "col"], "label")
    facts = data.groupBy(*keys, "col").agg(F.count("value").alias("filled"), *(f(number(F.col("value"))).alias(n) for f, n in ((F.min, "low"), (F.max, "high"), (F.avg, "mean"))))
    return classes.join(facts, [*keys, "col"]).join(bounds.select(*keys, "range"), keys).select(*keys, "range", "header", "col", F.col("label").alias("name"), "class", "filled", "low", "high", "mean")
