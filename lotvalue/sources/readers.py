"""Scans. Every reader is lazy and takes its schema from the package, never from inference."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, DoubleType, StringType, StructType

from ..functions.columns import coerce_number
from ..schemas import AUCTIONS, BAROMETER, DIESEL, EL_NINO, FUTURES, MAKES, Catalog
from .manifest import list_inputs

SMALL_FILE = 4 * 1024 * 1024        # not split by any scan


def read_delimited(spark: SparkSession, path, schema: StructType | None, sep: str = "\t") -> DataFrame:
    reader = spark.read.option("sep", sep).option("header", True).option("mode", "PERMISSIVE")
    if schema is None:
        return reader.csv(path)
    # Files may lack columns or order them differently: take the header's names, then give each its type.
    raw = reader.csv(path)
    known = {c.lower(): c for c in raw.columns}
    return raw.select(*[
        _cast(raw[known[f.name.lower()]], StringType(), f.dataType).alias(f.name)
        for f in schema.fields if f.name.lower() in known
    ])


def _cast(column: Column, stored: DataType, wanted: DataType) -> Column:
    """Text is a number only if it is a plain one: '12d' is not."""
    if isinstance(wanted, DoubleType) and isinstance(stored, StringType):
        return coerce_number(column, "string")
    return column.try_cast(wanted)


def typed(raw: DataFrame, schema: StructType | None) -> DataFrame:
    """Columns of the schema in its types, whatever type they were stored in; other columns as they are."""
    wanted = {f.name.lower(): f for f in schema.fields} if schema else {}
    return raw.select(*[
        raw[f"`{c}`"] if c.lower() not in wanted or raw.schema[c].dataType == wanted[c.lower()].dataType
        else _cast(raw[f"`{c}`"], raw.schema[c].dataType, wanted[c.lower()].dataType).alias(wanted[c.lower()].name)
        for c in raw.columns])


def expand_sized(spark: SparkSession, path: str) -> dict[str, int]:
    """The files or folders that a path with wildcards names, on whatever file system it is, and their bytes (0 for folders)."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return {s.getPath().toString(): s.getLen() if s.isFile() else 0 for s in system.globStatus(hadoop) or ()}


def expand(spark: SparkSession, path: str) -> list[str]:
    """The files or folders that a path with wildcards names, sorted."""
    return sorted(expand_sized(spark, path))


def first_match(spark: SparkSession, path: str) -> str:
    """The first of the matching files; the path itself if there is none, for the scan to complain about."""
    return next(iter(expand(spark, path)), path)


def read_table(spark: SparkSession, path, fmt: str, schema: StructType | None) -> DataFrame:
    if fmt == "parquet":
        return typed(spark.read.parquet(*([path] if isinstance(path, str) else path)), schema)
    if fmt == "tsv":
        return read_delimited(spark, path, schema)
    if fmt == "csv":
        return read_delimited(spark, path, schema, sep=",")
    raise ValueError(f"unknown format {fmt!r}")


def read_parts(spark: SparkSession, paths: list[str], fmt: str, schema: StructType | None = AUCTIONS) -> DataFrame:
    """Union of parts by column name; a column absent from a part is NULL there.

    Wildcards are expanded first, because one scan takes the columns of all its files from the first of them. Parts
    with the same columns are one scan, so a thousand parts of one layout are one scan, too.
    """
    sizes = {f: n for p in paths for f, n in expand_sized(spark, p).items()}
    files = sorted(sizes)
    if not files:
        raise FileNotFoundError(f"no input parts: {paths}")
    if fmt == "parquet":
        try:        # one job reads all footers; a column that a part lacks is NULL there
            return typed(spark.read.option("mergeSchema", True).parquet(*files), schema)
        except (PySparkException, Py4JJavaError) as conflict:      # a column of another type in some part
            if "CANNOT_MERGE" not in str(conflict):
                raise
        layouts = defaultdict(list)
        for f in files:
            layouts[tuple(spark.read.parquet(f).dtypes)].append(f)
    else:
        # A part may be a folder of files: each of them is judged by its own size.
        layouts = header_layouts(spark, {f: n for f, (n, _) in list_inputs(spark, files).items()})
    parts = [read_table(spark, some, fmt, schema) for some in layouts.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def header_layouts(spark: SparkSession, sizes: dict[str, int]) -> dict[str, list[str]]:
    """Files of delimited text (name -> bytes) by their first line, in one job for small files and one for large ones.

    Small files are read many to a task; a large one is a task of its own, which stops after the first line.
    """
    large = sorted(f for f, n in sizes.items() if n > SMALL_FILE)
    small = sorted(set(sizes) - set(large))

    def first_lines(batches):
        seen = set()
        for b in batches:
            new = [i for i, f in enumerate(b.column("file").to_pylist()) if f not in seen and not seen.add(f)]
            if new:
                yield b.take(new)

    def first_line(batches):
        for b in batches:
            if b.num_rows:
                yield b.slice(0, 1)
                return

    def lines(some: list[str], keep) -> list:
        first_block = F.col("_metadata.file_block_start") == 0
        rows = spark.read.text(some).filter(first_block).select(F.input_file_name().alias("file"), "value")
        return rows.mapInArrow(keep, "file string, value string").collect() if some else []      # one row per file

    whole = {"spark.sql.files.maxPartitionBytes": str(1 << 50), "spark.sql.files.openCostInBytes": str(1 << 50),
             "spark.sql.execution.arrow.maxRecordsPerBatch": "1"}
    found, before = lines(small, first_lines), {k: spark.conf.get(k) for k in whole}
    try:
        for k, v in whole.items():
            spark.conf.set(k, v)
        found += lines(large, first_line)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    layouts = defaultdict(list)
    for r in sorted(found):
        layouts[r["value"].rstrip("\r")].append(unquote(r["file"]))
    return layouts


def read_barometer(spark, path, fmt="tsv") -> DataFrame:
    return read_table(spark, path, fmt, BAROMETER)


def read_diesel(spark, path, fmt="tsv") -> DataFrame:
    return read_table(spark, path, fmt, DIESEL)


def read_el_nino(spark, path, fmt="tsv") -> DataFrame:
    return read_table(spark, path, fmt, EL_NINO)


def read_futures(spark, path, fmt="tsv") -> DataFrame:
    return read_table(spark, path, fmt, FUTURES)


def future_symbols(futures: DataFrame) -> DataFrame:
    return futures.select("future_symbol").distinct()


def read_makes(spark, path, fmt="tsv") -> DataFrame:
    return read_table(spark, path, fmt, MAKES)


def read_auctioneers(spark, path, fmt="tsv") -> DataFrame:
    return read_table(spark, path, fmt, None)


def load_catalog(spark: SparkSession, base: str, fmt: str = "tsv", auction_parts: list[str] | None = None) -> Catalog:
    """All seven tables under one folder. Auction parts default to ``auction_results_part*``.

    Of several exports of makes or auctioneers the first by name is read: two would multiply the lots.
    """
    ext = "parquet" if fmt == "parquet" else "csv"
    parts = auction_parts or [f"{base}/auction_results_part*.{ext}"]
    return Catalog(
        auctions=read_parts(spark, parts, fmt),
        makes=read_makes(spark, first_match(spark, f"{base}/makes*.{ext}"), fmt),
        barometer=read_barometer(spark, f"{base}/ag_economy_barometers.{ext}", fmt),
        diesel=read_diesel(spark, f"{base}/diesel_prices.{ext}", fmt),
        el_nino=read_el_nino(spark, f"{base}/el_nino_readings.{ext}", fmt),
        futures=read_futures(spark, f"{base}/future_prices.{ext}", fmt),
        auctioneers=read_auctioneers(spark, first_match(spark, f"{base}/auctioneers*.{ext}"), fmt),
    )


def first_existing(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """Parquet scan of the first path that exists, on whatever file system it names; None if none does."""
    for path in paths:
        try:
            return spark.read.parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    return None
