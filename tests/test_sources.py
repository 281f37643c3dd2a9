import datetime as dt
import uuid

import pytest

from lotvalue.schemas import AUCTIONS
from lotvalue.sources import readers, sinks


def write(path, text):
    path.write_text(text)
    return str(path)


def test_tsv_readers_and_catalog(spark, tmp_path):
    write(tmp_path / "auction_results_part1.csv", "price\tmake_key\tsold_date\n1000\tford\t2020-01-02\nx\tdeere\t\n")
    write(tmp_path / "ag_economy_barometers.csv", "date\tbarometer\n2020-01-01\t101.5\n")
    write(tmp_path / "diesel_prices.csv", "month_date\tprice_usd_per_gallon\n2020-01-01\t3.1\n")
    write(tmp_path / "el_nino_readings.csv", "year\tmonth\tvalue\tphase\n2020\t1\t0.5\t1\n")
    write(tmp_path / "future_prices.csv", "date\tfuture_symbol\tprice\tvol\n2020-01-05\tCorn\t3.5\t10\n2020-01-06\tCorn\t3.7\t\n")
    write(tmp_path / "makes_1.csv", "name\tmake_key\tstill_in_business\nFord\tford\ttrue\n")
    write(tmp_path / "auctioneers_1.csv", "id\tname\n1\tBob\n")
    catalog = readers.load_catalog(spark, str(tmp_path))
    assert [r.price for r in catalog.auctions.collect()] == [1000.0, None]
    assert catalog.auctions.first().sold_date == dt.datetime(2020, 1, 2)
    assert catalog.barometer.first().barometer == 101.5 and catalog.el_nino.first().month == 1
    assert [r[0] for r in readers.future_symbols(catalog.futures).collect()] == ["Corn"]
    assert catalog.makes.first().still_in_business is True and catalog.auctioneers.count() == 1

    from lotvalue.plans.datasets import training_dataset
    row = training_dataset(catalog, 2024).first()
    assert (row.make_name, row.barometer, row.diesel_price, row.el_nino_phase, row.corn_price) == (
        "Ford", 101.5, 3.1, 1.0, pytest.approx(3.6))


def test_parts_are_united_by_name(spark, tmp_path):
    a = write(tmp_path / "a.csv", "price\tmake_key\n1\tx\n")
    b = write(tmp_path / "b.csv", "make_key\tregion\ny\tr\n")
    out = readers.read_parts(spark, [b, a], "tsv", AUCTIONS)
    assert sorted((r.make_key, r.price, r.region) for r in out.collect()) == [("x", 1.0, None), ("y", None, "r")]
    with pytest.raises(FileNotFoundError):
        readers.read_parts(spark, [], "tsv")
    spark.createDataFrame([(1, "p")], "id int, c string").write.parquet(str(tmp_path / "p1"))
    spark.createDataFrame([(2, 5.0)], "id int, d double").write.parquet(str(tmp_path / "p2"))
    merged = readers.read_parts(spark, [str(tmp_path / "p1"), str(tmp_path / "p2")], "parquet")
    assert sorted((r.id, r.c, r.d) for r in merged.collect()) == [(1, "p", None), (2, None, 5.0)]


def test_wildcard_parts_with_other_columns(spark, tmp_path):
    write(tmp_path / "auction_results_part1.csv", "price\thours\tmake_key\n1000\t10\ta\n")
    write(tmp_path / "auction_results_part2.csv", "make_key\tprice\thours\tregion\nb\t2000\t20\tr\n")
    write(tmp_path / "auction_results_part3.csv", "price\thours\tmake_key\n3000\t30\tc\n")
    out = readers.read_parts(spark, [str(tmp_path / "auction_results_part*.csv")], "tsv", AUCTIONS)
    assert sorted((r.make_key, r.price, r.hours, r.region) for r in out.collect()) == [
        ("a", 1000.0, 10.0, None), ("b", 2000.0, 20.0, "r"), ("c", 3000.0, 30.0, None)]
    with pytest.raises(FileNotFoundError):
        readers.read_parts(spark, [str(tmp_path / "nothing*.csv")], "tsv")


def test_parts_that_are_folders(spark, tmp_path, monkeypatch):
    """Files in a folder part count by their own sizes, and a layout may differ inside the folder."""
    folder = tmp_path / "auction_results_part1.csv"
    folder.mkdir()
    write(folder / "part-0.csv", "price\thours\tmake_key\n1000\t10\ta\n")
    write(folder / "part-1.csv", "make_key\tprice\nb\t2000\n" + "c\t3000\n" * 200)
    write(folder / "_SUCCESS", "")
    write(tmp_path / "auction_results_part2.csv", "price\tregion\n4000\tr s\n")
    seen = []
    inner = readers.header_layouts
    monkeypatch.setattr(readers, "header_layouts", lambda s, sizes: seen.append(sizes) or inner(s, sizes))
    monkeypatch.setattr(readers, "SMALL_FILE", 1000)
    out = readers.read_parts(spark, [str(tmp_path / "auction_results_part*.csv")], "tsv", AUCTIONS)
    assert out.count() == 203 and out.where("make_key = 'c' and hours is null and price = 3000").count() == 200
    assert sorted((r.price, r.hours, r.region) for r in out.where("make_key = 'a' or region is not null").collect()) == [
        (1000.0, 10.0, None), (4000.0, None, "r s")]
    assert len(seen[0]) == 3 and max(seen[0].values()) > 1000


def test_first_export_and_parquet_types(spark, tmp_path):
    write(tmp_path / "makes_1.csv", "name\tmake_key\nFord\tford\n")
    write(tmp_path / "makes_2.csv", "name\tmake_key\nFord\tford\n")
    assert readers.read_makes(spark, readers.first_match(spark, f"{tmp_path}/makes*.csv")).count() == 1
    spark.createDataFrame([("12", "x"), ("12d", "y")], "price string, note string").write.parquet(str(tmp_path / "p"))
    out = readers.read_parts(spark, [str(tmp_path / "p")], "parquet", AUCTIONS)
    assert sorted((r.price is None, r.price, r.note) for r in out.collect()) == [(False, 12.0, "x"), (True, None, "y")]


def test_fallback_and_build_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([(dt.datetime(2019, 5, 1), 1.0), (dt.datetime(2020, 5, 1), 2.0)],
                                     "sold_date timestamp_ntz, price double")

    path = str(tmp_path / "training")
    assert readers.first_existing(spark, [path]) is None
    assert sinks.read_or_build(spark, path, build).count() == 2
    again = sinks.read_or_build(spark, path, build)
    assert len(built) == 1 and again.filter("sale_year = 2020").count() == 1
    assert len(again.filter("sale_year = 2020").inputFiles()) >= 1
    assert readers.first_existing(spark, [str(tmp_path / "nope"), path]).count() == 2
    sinks.write_features(again, str(tmp_path / "features"))
    assert spark.read.parquet(str(tmp_path / "features")).count() == 2


def _jobs(spark, work):
    group = f"layouts-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "")
    out = work()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_many_parts_of_few_layouts_take_a_constant_number_of_jobs(spark, tmp_path, monkeypatch):
    headers = ["price\tregion", "region\tprice", "price\tyear\tregion"]

    def parts(name, n):
        folder = tmp_path / name
        folder.mkdir()
        for k in range(n):
            values = {"price": str(k), "region": f"r{k}", "year": "2001"}
            names = headers[k % 3].split("\t")
            (folder / f"auction_results_part{k}.csv").write_text(headers[k % 3] + "\n" + "\t".join(values[c] for c in names) + "\n")
        return [f"{folder}/auction_results_part*.csv"]

    few, many = parts("few", 120), parts("many", 2000)
    small, n_small = _jobs(spark, lambda: readers.read_parts(spark, few, "tsv"))
    large, n_large = _jobs(spark, lambda: readers.read_parts(spark, many, "tsv"))
    assert n_small == n_large < 12
    assert small.count() == 120 and large.count() == 2000
    row = large.agg({"price": "sum", "year": "count"}).first()
    assert row["sum(price)"] == sum(range(2000)) and row["count(year)"] == len(range(2, 2000, 3))
    assert large.filter("region = concat('r', cast(price AS int))").count() == 2000
    monkeypatch.setattr(readers, "SMALL_FILE", 10)          # each file is a task of its own now
    again = readers.header_layouts(spark, readers.expand_sized(spark, few[0]))
    assert {h: len(f) for h, f in again.items()} == {h: 40 for h in headers}


def test_parquet_parts_with_other_columns_and_types(spark, tmp_path):
    for k in range(40):
        df = spark.createDataFrame([(float(k), "a")], "price double, region string")
        (df if k % 2 else df.drop("region")).write.parquet(str(tmp_path / f"p{k}"))
    out, jobs = _jobs(spark, lambda: readers.read_parts(spark, [f"{tmp_path}/p*"], "parquet"))
    assert out.count() == 40 and out.filter("region IS NULL").count() == 20 and jobs < 6
    spark.createDataFrame([("12d", "b"), ("7", "b")], "price string, region string").write.parquet(str(tmp_path / "odd"))
    mixed = readers.read_parts(spark, [f"{tmp_path}/p*", f"{tmp_path}/odd"], "parquet")
    assert dict(mixed.dtypes)["price"] == "double" and mixed.count() == 42 and mixed.filter("region = 'b' AND price IS NULL").count() == 1
