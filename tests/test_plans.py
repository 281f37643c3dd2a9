"""Plans are part of the contract: no Python workers, no single-task step over lots, filters at the scan."""

import re

import pytest

from checks import inputs as i
from checks.registry import QUERIES
import __spark_entry__  # noqa: F401  (registers the queries)
from lotvalue.operators import ranking
from lotvalue.plans.datasets import enrich
from lotvalue.sources import roles


def plan(df, capfd):
    df.explain("formatted")
    return capfd.readouterr().out


@pytest.mark.parametrize("name", ["training_dataset", "features_all", "impute_year_hours", "spec_flags", "model_route",
                                  "confidence_band", "rolling_price_trend", "error_ecdf"])
def test_no_python_workers(spark, sf_dir, capfd, name):
    text = plan(QUERIES[name](spark, sf_dir), capfd)
    assert not re.search(r"PythonUDF|BatchEvalPython|ArrowEvalPython|MapInPandas", text)


def test_training_joins_lots_twice_and_prunes_the_scan(spark, sf_dir, capfd):
    lots = i.lots(spark, sf_dir, "lot_order")
    text = plan(enrich(lots, roles.catalog(spark, sf_dir, ["lot_order"]), roles.FUTURE_SYMBOLS), capfd)
    assert len(re.findall(r"^\(\d+\) BroadcastHashJoin", text, re.M)) == 3      # part, makes, calendar
    assert "SortMergeJoin" not in text and "BroadcastNestedLoopJoin" not in text
    assert "GreaterThanOrEqual(l_shipdate" in text
    assert "o_custkey" not in text and "l_extendedprice" not in text


def test_single_table_queries_scan_one_table(spark, sf_dir, capfd):
    text = plan(i.clean(spark, sf_dir, "hours", "sold_date"), capfd)
    assert text.count("Scan parquet") == 2      # once in the tree, once in the details
    assert "ReadSchema: struct<l_linenumber:int,l_quantity:double,l_shipdate:timestamp_ntz>" in text


def test_split_and_rank_never_gather_lots_in_one_task(spark, sf_dir, capfd):
    lots = i.lots(spark, sf_dir, *i.TIES)
    for df in (ranking.positional_rank(lots, "sold_date", i.TIES, bucket=i.bucket()),
               ranking.time_split(lots, "sold_date", i.TIES, bucket=i.bucket())):
        text = plan(df, capfd)
        for exchange in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]\nArguments: SinglePartition", text):
            assert "lot_line" not in exchange or "_first" in exchange or "max" in exchange, exchange


def test_rank_shuffles_lots_once(spark, sf_dir, capfd):
    lots = i.lots(spark, sf_dir, *i.TIES)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(ranking.positional_rank(lots.select(*i.TIES, "sold_date"), "sold_date", i.TIES, bucket=i.bucket()), capfd)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]\nArguments: hashpartitioning\(_day[^)]*_bucket", text)
    assert sum("lot_seller" in columns for columns in shuffles) == 1


def test_top_models_limits_groups_before_the_shuffle(spark, sf_dir, capfd):
    assert "WindowGroupLimit" in plan(QUERIES["top_models_per_make"](spark, sf_dir), capfd)
