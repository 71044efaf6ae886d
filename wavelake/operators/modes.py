"""What becomes of rows that carry an error: reader modes, and the first error of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERMISSIVE, DROPMALFORMED, FAILFAST = "PERMISSIVE", "DROPMALFORMED", "FAILFAST"


def first_errors(rows: DataFrame, file: list[str], order: list[str], error: str = "error") -> DataFrame:
    """(file, order, error): of each file the error of the row that comes first in `order`; files without one are left
    out. One row of each task and file is shuffled."""
    least = F.min_by(F.struct(*order, error), F.struct(*order)).alias("first")
    return rows.where(F.col(error).isNotNull()).groupBy(*file).agg(least).select(*file, *(f"first.{c}" for c in [*order, error]))


def in_mode(rows: DataFrame, mode: str, order: list[str], error: str = "error") -> DataFrame:
    """`rows` as a reader of that mode gives them: PERMISSIVE all, DROPMALFORMED those without an error, FAILFAST all if none
    has one, and else the query fails with the error that comes first in `order`, whichever task met it."""
    if mode == PERMISSIVE:
        return rows
    if mode == DROPMALFORMED:
        return rows.where(F.col(error).isNull())
    if mode != FAILFAST:
        raise ValueError(f"mode {mode}")
    place = F.concat_ws(", ", *(F.concat(F.lit(f"{c} "), F.col(c).cast("string")) for c in order))
    bad = rows.where(F.col(error).isNotNull()).agg(F.min_by(F.concat(place, F.lit(": "), F.col(error)), F.struct(*order)).alias("first"))
    kept = rows.withColumn("_first", bad.scalar())
    return kept.where(F.when(F.col("_first").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("_first")).cast("boolean"))).drop("_first")


def strict(parts: DataFrame, file: list[str], damaged: str) -> DataFrame:
    """Rows of the files none of whose parts is damaged: a strict reader's; a relaxed one keeps all with their mark."""
    bad = F.max(F.coalesce(F.expr(damaged), F.lit(False))).over(Window.partitionBy(*file))
    no_file = F.greatest(F.lit(False), *(F.col(c).isNull() for c in file))  # a row of no file shares none's damage
    return parts.withColumn("_bad", bad).where(~F.col("_bad") | no_file).drop("_bad")
