"""How often lots move: joins at their place in the plan, and exports that are joined once."""

from checks import file_queries
from lotvalue.sources import readers, roles


def test_orders_get_their_customers_before_the_lots_are_joined(spark, sf_dir):
    """The lots move once for orders and customers together, and once for parts, whose texts come last."""
    plan = roles.auctions(spark, sf_dir, ["lot_order", "price", "make_key", "region"])._jdf.queryExecution().optimizedPlan().toString()
    depth = {key: line.index("Join") for line in plan.splitlines() if "Join LeftOuter" in line
             for key in ("c_custkey", "o_orderkey", "p_partkey", "r_regionkey") if key in line}
    assert depth["r_regionkey"] < depth["p_partkey"] < depth["o_orderkey"] < depth["c_custkey"]


def test_both_catalogs_export_lots_that_were_joined_once(spark, sf_dir, monkeypatch):
    made, real = [], file_queries.i.raw
    monkeypatch.setattr(file_queries.i, "raw", lambda *a: made.append(a) or real(*a))
    rows = {(r.fmt, r.table_name): r.n_rows for r in file_queries.load_catalog(spark, sf_dir).collect()}
    assert len(made) == 1 and len(rows) == 14
    assert rows["tsv", "auctions"] == rows["parquet", "auctions"] == roles.table(spark, sf_dir, "lineitem").count()


def bytes_of(folder):
    return sum(f.stat().st_size for f in folder.rglob("part-*"))


def test_exported_text_is_compressed(spark, tmp_path):
    """Text was most of what the queries over files wrote."""
    rows = spark.range(20000).selectExpr("id AS price", "concat(' make-', id % 7) AS make_key", "'' AS raw_price", "cast(NULL AS string) AS state")
    plain, path = tmp_path / "plain", file_queries.export(rows, f"{tmp_path}/parts.csv", "tsv")
    rows.write.option("sep", "\t").option("header", True).csv(str(plain))
    assert bytes_of(tmp_path / "parts.csv") < bytes_of(plain) / 2
    back = readers.read_parts(spark, [f"{tmp_path}/parts*.csv"], "tsv")
    assert back.count() == 20000 and back.agg({"price": "sum"}).first()[0] == 20000 * 19999 / 2
    assert {r[0] for r in back.select("make_key").distinct().collect()} == {f" make-{k}" for k in range(7)}


def test_lots_are_gathered_by_year_before_they_are_wide(spark, sf_dir):
    """Makes and the monthly series are joined to rows that don't move any more."""
    plan = file_queries._training_from_files(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    at = next(line.index("Rebalance") for line in lines if "Rebalance" in line)
    assert at > max(line.index("Join") for line in lines if "Join LeftOuter" in line)
