"""What a stored table was made from, and which parts of it have to be made anew.

The manifest is one small file next to the data: the input files with their sizes and times, what each of them touched, the
parameters, and what is being written just now. It is the commit marker. A table without one is not built; one that names
pending work was left in the middle of it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

NAME = "_manifest.json"


def _system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), hadoop


def plain(path: str) -> str:
    """One spelling of a file's name, for listings and for ``input_file_name``."""
    scheme, _, rest = unquote(path).partition(":/") if ":/" in path else ("file", "", unquote(path))
    return f"{scheme}:/{rest.lstrip('/')}" if scheme == "file" else f"{scheme}:/{rest}"


def list_inputs(spark: SparkSession, paths: list[str]) -> dict[str, list[int]]:
    """Every file that the paths (wildcards, folders) name, with its size and modification time."""
    found = {}
    for path in paths:
        system, hadoop = _system(spark, path)
        for status in system.globStatus(hadoop) or ():
            files = system.listFiles(status.getPath(), True)
            while files.hasNext():
                f = files.next()
                if not f.getPath().getName().startswith(("_", ".")):
                    found[plain(f.getPath().toString())] = [f.getLen(), f.getModificationTime()]
    return found


def _content(spark: SparkSession, file, system) -> str:
    stream = system.open(file)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """None if there is none, or if it was cut off while it was written."""
    system, file = _system(spark, f"{path}/{NAME}")
    if not system.exists(file):
        return None
    try:
        return json.loads(_content(spark, file, system))
    except ValueError:
        return None
    except Py4JJavaError as error:          # its checksum tells that it was cut off
        if "ChecksumException" not in str(error.java_exception):
            raise
        return None


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    system, file = _system(spark, f"{path}/{NAME}")
    out = system.create(file, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()


def finished(spark: SparkSession, path: str) -> bool:
    """Whether Spark wrote the folder to its end."""
    system, mark = _system(spark, f"{path}/_SUCCESS")
    return system.exists(mark)


def remove(spark: SparkSession, path: str) -> None:
    system, folder = _system(spark, path)
    system.delete(folder, True)


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace the folders of ``by`` that ``df`` has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def changed(old: dict, inputs: dict) -> tuple[list[str], list[str]]:
    """Files that are new or differ, and files that are gone."""
    return sorted(f for f in inputs if old["inputs"].get(f) != inputs[f]), sorted(f for f in old["inputs"] if f not in inputs)


def touched_by(read: Callable[[list[str]], DataFrame], files: list[str], value) -> dict[str, list]:
    """Which values (sale years) each file holds rows of: one pass over two columns of these files."""
    if not files:
        return {}
    pairs = read(files).select(F.input_file_name().alias("file"), value.alias("value")).distinct().collect()   # files x years
    out: dict[str, list] = {f: [] for f in files}
    for r in pairs:
        out[plain(r["file"])].append(r["value"])
    return out


def build_by_year(spark: SparkSession, path: str, parts: list[str], read: Callable[[list[str]], DataFrame],
                  build: Callable[[DataFrame], DataFrame], params: dict | None = None, date: str = "sold_date") -> DataFrame:
    """The table at ``path``, built from ``parts`` by ``build`` and stored by sale year; only what is out of date is built.

    Nothing is done if no file and no parameter changed. A new, changed or removed file makes the years anew that it holds
    or held rows of, from all files that hold rows of these years; other years are neither read nor written. Before files are
    touched, the manifest says which years are pending; a run that ended before its commit is made good for
    these years by the next one. Other parameters build everything. ``build`` must work row by row (no medians over the table).
    """
    inputs, params = list_inputs(spark, parts), params or {}
    old = read_manifest(spark, path)
    if old is None or old["params"] != params:
        old = {"inputs": {}, "years": {}, "params": params, "pending": None}
        remove(spark, path)
    new, gone = changed(old, inputs)
    if not new and not gone and not old["pending"]:
        return spark.read.parquet(path)
    year = F.year(F.col(date))
    held = {f: y for f, y in old["years"].items() if f not in new and f not in gone} | touched_by(read, new, year)
    years = {y for f in new for y in held[f]} | {y for f in [*new, *gone] for y in old["years"].get(f, [])} | set(old["pending"] or [])
    write_manifest(spark, path, {**old, "pending": sorted(years, key=str)})
    sources = sorted(f for f in inputs if years & set(held[f]))
    dated = [y for y in years if y is not None]
    wanted = year.isin(dated) | (year.isNull() if None in years else F.lit(False))
    left: set = set()
    if sources:
        made = build(read(sources).filter(wanted)).withColumn("sale_year", F.year(date))
        seen = Observation()
        overwrite_partitions(made.hint("rebalance", "sale_year").observe(
            seen, F.collect_set("sale_year").alias("years"), F.count_if(F.col("sale_year").isNull()).alias("undated")), path, "sale_year")
        left = set(seen.get["years"]) | ({None} if seen.get["undated"] else set())
    for y in years - left:                                  # nothing of these years is left
        remove(spark, f"{path}/sale_year={'__HIVE_DEFAULT_PARTITION__' if y is None else y}")
    write_manifest(spark, path, {"inputs": inputs, "years": held, "params": params, "pending": None})
    return spark.read.parquet(path)
