"""Positions, time splits and rolling trends without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

BUCKETS = 256            # cells a day is cut into, so that one busy day is not one task
BLOCK_ROWS = 1_000_000   # rows of one key that a rolling window handles in one task
LAST_DAY = "9999-12-31"  # missing dates sort last


def _cells(df: DataFrame, date: str, ties: list[str], bucket: Column | None) -> DataFrame:
    if bucket is None:
        bucket = F.pmod(F.xxhash64(*ties), F.lit(BUCKETS))
    day = F.coalesce(F.col(date).cast("date"), F.lit(LAST_DAY).cast("date"))
    return df.withColumns({"_day": day, "_bucket": bucket})


def _cell_starts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows before each (keys, day, bucket) cell. Only counts are sorted: days first, then buckets in a day."""
    per_cell = cells.groupBy(*keys, "_day", "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    per_day = (per_cell.groupBy(*keys, "_day").agg(F.sum("_n").alias("_day_n"))
                       .withColumn("_day_start", F.coalesce(F.sum("_day_n").over(earlier), F.lit(0))))
    in_day = Window.partitionBy(*keys, "_day").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (per_cell.withColumn("_in_day", F.coalesce(F.sum("_n").over(in_day), F.lit(0)))
                    .join(per_day, [*keys, "_day"])
                    .select(*keys, "_day", "_bucket", "_n", (F.col("_day_start") + F.col("_in_day")).alias("_start")))


def positional_rank(df: DataFrame, date: str, ties: list[str], keys: list[str] | None = None,
                    bucket: Column | None = None, name: str = "position") -> DataFrame:
    """1-based position of every row by (day, bucket, ties), over the table or within ``keys``.

    Counts per cell give each cell its offset; rows are numbered inside their cell only. The offsets have the
    same partitioning as the numbered rows, so the rows are shuffled once. A cell is one task's work: ``ties`` should
    tell rows apart, because rows equal in all of them share a cell.
    """
    keys = keys or []
    cells = _cells(df, date, ties, bucket)
    inside = Window.partitionBy(*keys, "_day", "_bucket").orderBy(*ties)
    return (cells.withColumn("_row", F.row_number().over(inside))
                 .join(_cell_starts(cells, keys).drop("_n"), [*keys, "_day", "_bucket"])
                 .withColumn(name, F.col("_start") + F.col("_row"))
                 .drop("_day", "_bucket", "_row", "_start"))


def split_fractions(val: float, test: float) -> tuple[float, float]:
    """Share of rows before the validation part and before the test part, in double arithmetic."""
    return 1 - val - test, 1 - test


def _order(ties: list[str]) -> Column:
    return F.struct("_day", "_bucket", *ties)


def _label(first_val: Column, first_test: Column, ties: list[str]) -> Column:
    order = _order(ties)
    return F.when(order < first_val, "train").when(order < first_test, "val").otherwise("test")


def split_cuts(df: DataFrame, date: str, ties: list[str], val: float = 0.15, test: float = 0.15,
               bucket: Column | None = None) -> DataFrame:
    """One row with the place of the first validation row and of the first test row.

    Counts per cell find the two cells that hold the cuts; only the rows of those two cells are ranked.
    """
    before_val, before_test = split_fractions(val, test)
    cells = _cells(df, date, ties, bucket)
    starts = materialize(_cell_starts(cells, []), "cell-starts")        # days x buckets; used twice
    total = starts.agg(F.sum("_n").cast("double").alias("_total"))
    cut_cells = (starts.crossJoin(F.broadcast(total))
        .select("_day", "_bucket", "_start", "_n", F.inline(F.array(
            F.struct(F.lit("val").alias("_cut"), F.floor(F.col("_total") * F.lit(before_val)).alias("_at")),
            F.struct(F.lit("test").alias("_cut"), F.floor(F.col("_total") * F.lit(before_test)).alias("_at")))))
        .filter((F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_start") + F.col("_n")))
        .drop("_n"))
    inside = Window.partitionBy("_cut").orderBy(*ties)
    return (cells.join(F.broadcast(cut_cells), ["_day", "_bucket"])      # two cells at most
        .withColumn("_row", F.row_number().over(inside) - 1)
        .filter(F.col("_row") == F.col("_at") - F.col("_start"))
        .agg(F.max(F.when(F.col("_cut") == "val", _order(ties))).alias("_first_val"),
             F.max(F.when(F.col("_cut") == "test", _order(ties))).alias("_first_test")))


def time_split(df: DataFrame, date: str, ties: list[str], val: float = 0.15, test: float = 0.15,
               bucket: Column | None = None) -> DataFrame:
    """Adds ``split``: the earliest rows train, the next validate, the latest test.

    Every row is compared with the two cuts, so rows are neither sorted nor moved. ``ties`` must tell rows apart
    for exact sizes: rows equal in date, bucket and all ties fall on the same side of a cut.
    """
    cuts = split_cuts(df, date, ties, val, test, bucket)
    labelled = _cells(df, date, ties, bucket).crossJoin(F.broadcast(cuts)).withColumn(      # one row
        "split", _label(F.col("_first_val"), F.col("_first_test"), ties))
    return labelled.drop("_day", "_bucket", "_first_val", "_first_test")


def apply_cuts(df: DataFrame, cuts, date: str, ties: list[str], bucket: Column | None = None) -> DataFrame:
    """``time_split`` with cuts already fetched (the row of ``split_cuts``): a plain CASE, for tables read often."""
    cells = _cells(df, date, ties, bucket)
    types = dict(cells.dtypes)

    def fixed(place) -> Column:
        return F.struct(*[F.lit(place[c]).cast(types[c]).alias(c) for c in ("_day", "_bucket", *ties)])

    return cells.withColumn("split", _label(fixed(cuts["_first_val"]), fixed(cuts["_first_test"]), ties)
                            ).drop("_day", "_bucket")


def rolling_trend(df: DataFrame, key: str, date: str, ties: list[str], value: str, window: int = 6, lag: int = 6,
                  include_current: bool = True, bucket: Column | None = None,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean of the last ``window`` rows per key, and its change against ``lag`` rows earlier.

    A key's history is cut into blocks by position. Each block also receives the rows just before it, enough
    for the longest look-back, so that blocks are computed apart and one busy key is many tasks.
    With ``include_current=False`` the row's own value is left out, which is what a model feature needs.
    """
    reach = window + lag
    if block_rows < reach:
        raise ValueError("a block must hold at least window + lag rows")
    ranked = positional_rank(df.filter(F.col(key).isNotNull()), date, ties, [key], bucket, "_pos")
    own = F.floor((F.col("_pos") - 1) / block_rows)
    feeds_next = (F.col("_pos") - 1) % block_rows >= block_rows - reach
    blocks = ranked.withColumn("_own", own).withColumn(
        "_block", F.explode(F.when(feeds_next, F.array(own, own + 1)).otherwise(F.array(own))))
    ordered = Window.partitionBy(key, "_block").orderBy("_pos")
    frame = ordered.rowsBetween(-(window - 1), 0) if include_current else ordered.rowsBetween(-window, -1)
    trend = (blocks.withColumn("rolling_mean", F.avg(value).over(frame))
                   .withColumn("momentum", F.col("rolling_mean") - F.lag("rolling_mean", lag).over(ordered))
                   .filter(F.col("_own") == F.col("_block"))
                   .drop("_pos", "_own", "_block"))
    keyless = df.filter(F.col(key).isNull()).withColumns(
        {"rolling_mean": F.lit(None).cast("double"), "momentum": F.lit(None).cast("double")})
    return trend.unionByName(keyless)
