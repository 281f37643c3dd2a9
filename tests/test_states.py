import os
import random

import pytest
from pyspark.sql import functions as F

from checks import inputs as i
from lotvalue.operators import features, states
from lotvalue.operators.profiling import make_stats
from lotvalue.sources import manifest
from lotvalue.sources.sinks import read_or_build, write_features


@pytest.fixture(scope="module")
def lots(spark, sf_dir):
    return i.stored_training(spark, sf_dir, "sold_date", "price", "hours", "make_key", "make_model_key", "raw_category").withColumn(
        "year", F.year("sold_date"))


def test_merged_moments_and_levels_equal_the_union(lots):
    want = features.fit_statistics(lots).first()
    per_year = states.moment_states(lots, "year", ["barometer", "diesel_price"])
    assert per_year.count() > 4
    assert states.merged_fit(per_year).first().asDict() == pytest.approx(want.asDict(), rel=1e-12)
    names = ["make_key", "raw_category"]
    merged, whole = states.merge_levels(states.level_states(lots, "year", names)), features.frequency_table(lots, names)
    assert merged.exceptAll(whole).isEmpty() and whole.exceptAll(merged).isEmpty()


def test_moments_do_not_cancel(spark):
    rows = [(p, 1e9 + random.Random(p * 100 + j).random()) for p in range(5) for j in range(50)]
    df = spark.createDataFrame([*rows, (9, None)], "p int, x double")
    merged, plain = states.merge_moments(states.moment_states(df, "p", ["x"])).first(), df.agg(F.count("x"), F.avg("x"), F.stddev("x")).first()
    assert (merged.n, merged["mean"]) == (plain[0], pytest.approx(plain[1], rel=1e-12)) and merged["std"] == pytest.approx(plain[2], rel=1e-6)
    empty = states.merge_moments(states.moment_states(df.filter("p = 9"), "p", ["x"])).first()
    assert (empty.n, empty["mean"], empty["std"]) == (0, None, None)


def test_only_new_and_changed_parts_are_read(spark, lots, tmp_path):
    years = sorted(r.year for r in lots.select("year").distinct().collect())[:4]
    for y in years:
        lots.filter(F.col("year") == y).coalesce(1).write.parquet(str(tmp_path / f"raw/{y}"))
    read = []

    def scan(name):
        read.append(name)
        return spark.read.parquet(str(tmp_path / f"raw/{name}"))

    def update(some):
        read.clear()
        return states.update_states(spark, str(tmp_path / "st"), {str(y): str(tmp_path / f"raw/{y}") for y in some}, scan,
                                    states.fit_kinds(["make_key"]))

    def check(some):
        union = lots.filter(F.col("year").isin(some))
        got = states.merged_fit(spark.read.parquet(str(tmp_path / "st/moments"))).first().asDict()
        assert got == pytest.approx(features.fit_statistics(union).first().asDict(), rel=1e-9)
        levels = states.merge_levels(spark.read.parquet(str(tmp_path / "st/levels")))
        assert levels.exceptAll(features.frequency_table(union, ["make_key"])).isEmpty()

    assert update(years[:3]) == [str(y) for y in years[:3]]
    check(years[:3])
    assert update(years) == [str(years[3])] and set(read) == {str(years[3])}
    check(years)
    assert update(years) == [] and read == []
    assert update(years[1:]) == [] and read == []                        # a part that is gone is taken out, unread
    check(years[1:])
    lots.filter(F.col("year") == years[1]).limit(5).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"raw/{years[1]}"))
    assert update(years[1:]) == [str(years[1])]
    manifest.write_manifest(spark, str(tmp_path / "st"), {"cut": 1})     # as if it had been lost: all is read again
    os.truncate(tmp_path / "st" / manifest.NAME, 5)
    assert update(years[1:]) == [str(y) for y in years[1:]]


def test_distinct_sketches_merge_in_any_order(lots):
    wanted = ["make_model_key", "make_key"]
    per_year = states.distinct_states(lots, "year", wanted)
    exact = lots.agg(*[F.count_distinct(c).alias(c) for c in wanted]).first()
    got = {r.feature: r.n_distinct for r in states.merge_distinct(per_year).collect()}
    for c in wanted:
        assert got[c] == pytest.approx(exact[c], rel=0.05)
    for seed in (1, 2):
        shuffled = per_year.repartition(3, F.xxhash64("year", F.lit(seed)))
        assert {r.feature: r.n_distinct for r in states.merge_distinct(shuffled).collect()} == got


@pytest.mark.parametrize("k,error", [(200, 0.02), (400, 0.012)])
def test_rank_error_of_merged_quantiles_in_every_group(lots, k, error):
    per_year = states.quantile_states(lots, "year", ["make_key"], ["price", "hours"], k)
    merged = states.merge_quantiles(per_year, ["make_key"], [0.25, 0.5, 0.9], k).collect()
    values = {}
    for r in lots.select("make_key", "price", "hours").collect():
        for c in ("price", "hours"):
            if r[c] is not None:
                values.setdefault((r.make_key, c), []).append(r[c])
    assert {(r.make_key, r.feature) for r in merged if r.n} == set(values)
    for r in merged:
        own = sorted(values.get((r.make_key, r.feature), []))
        assert r.n == len(own)
        for q, p in ((r.q0, 0.25), (r.q1, 0.5), (r.q2, 0.9)):
            if own:
                below, upto = sum(v < q for v in own) / len(own), sum(v <= q for v in own) / len(own)
                assert below - error <= p <= upto + error, (r, p)


def test_reports_by_sketch_write_no_value_counts(lots, monkeypatch):
    """Every group of ``make_stats``: counts are exact, medians are within the rank error, and no table is written."""
    from lotvalue.operators import profiling, quantiles
    exact = {r.make_key: r for r in make_stats(lots, top=1000).collect()}
    monkeypatch.setattr(quantiles, "materialize", None)
    near = {r.make_key: r for r in make_stats(lots, top=1000, approximate=True).collect()}
    assert set(near) == set(exact) and all(near[k].n_sales == exact[k].n_sales for k in exact)
    for r in lots.filter("price > 0").groupBy("make_key").agg(F.sort_array(F.collect_list("price")).alias("p")).collect():
        if r.make_key in near:
            q = near[r.make_key].median_price
            assert sum(p < q - 1 for p in r.p) / len(r.p) <= 0.52 and sum(p > q + 1 for p in r.p) / len(r.p) <= 0.52
    assert profiling.regional_stats(lots.withColumn("region", F.col("make_key")), approximate=True).count() == len(exact)
    assert profiling.yearly_sales(lots, approximate=True).count() == profiling.monthly_sales(lots, "1900-01-01", approximate=True).select(
        F.year("month")).distinct().count()
    counts = {r.field: r.n_distinct for r in profiling.distinct_counts(lots, ["make_key"], approximate=True).collect()}
    assert counts["make_key"] == pytest.approx(len(exact), abs=1)


# -- manifests -------------------------------------------------------------------------------------------------

def _write(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.csv", "w") as f:
        f.write("sold_date,price\n" + "".join(f"{d},{p}\n" for d, p in rows))


@pytest.fixture
def built(spark, tmp_path):
    raw, out, seen = str(tmp_path / "raw"), str(tmp_path / "out"), []

    def read(files):
        seen.append(sorted(os.path.basename(f) for f in files))
        return spark.read.schema("sold_date date, price double").option("header", True).csv(files)

    def build(fail=None, **params):
        seen.clear()

        def step(df):
            if fail:
                df = df.withColumn("price", F.when(F.col("price") >= 0, F.raise_error(F.lit("lost"))).otherwise(F.col("price")).cast("double"))
            return df.filter("price > 0")
        table = manifest.build_by_year(spark, out, [f"{raw}/*.csv"], read, step, params)
        return sorted((str(r.sold_date), r.price) for r in table.collect())
    return raw, out, seen, build


def _files(out, year):
    return {f: os.stat(f"{out}/sale_year={year}/{f}").st_mtime_ns for f in os.listdir(f"{out}/sale_year={year}") if f.endswith(".parquet")}


def test_only_touched_years_are_built(built):
    raw, out, seen, build = built
    _write(raw, "a", [("2020-05-01", 1.0), ("2021-05-01", 2.0)])
    _write(raw, "b", [("2022-05-01", 3.0), ("2022-06-01", -1.0)])
    assert build() == [("2020-05-01", 1.0), ("2021-05-01", 2.0), ("2022-05-01", 3.0)]
    old = {y: _files(out, y) for y in (2020, 2021, 2022)}
    assert len(build()) == 3 and seen == []                                           # nothing changed, nothing read
    _write(raw, "c", [("2021-07-01", 5.0)])
    assert build() == [("2020-05-01", 1.0), ("2021-05-01", 2.0), ("2021-07-01", 5.0), ("2022-05-01", 3.0)]
    assert _files(out, 2020) == old[2020] and _files(out, 2022) == old[2022] and _files(out, 2021) != old[2021]
    assert seen == [["c.csv"], ["a.csv", "c.csv"]]                                    # b holds nothing of that year
    _write(raw, "b", [("2023-05-01", 30.5)])                                          # changed: leaves 2022, enters 2023
    assert build() == [("2020-05-01", 1.0), ("2021-05-01", 2.0), ("2021-07-01", 5.0), ("2023-05-01", 30.5)]
    assert not os.path.exists(f"{out}/sale_year=2022") and _files(out, 2020) == old[2020]
    os.remove(f"{raw}/c.csv")
    assert build() == [("2020-05-01", 1.0), ("2021-05-01", 2.0), ("2023-05-01", 30.5)]
    assert len(build(as_of=2025)) == 3 and seen[-1] == ["a.csv", "b.csv"]             # other parameters: everything


def test_a_crash_before_the_commit_is_made_good(spark, built):
    raw, out, seen, build = built
    _write(raw, "a", [("2020-05-01", 1.0), (None, 7.0)])
    with pytest.raises(Exception, match="lost"):
        build(fail=True)
    assert manifest.read_manifest(spark, out)["pending"] and build() == [("2020-05-01", 1.0), ("None", 7.0)]
    _write(raw, "b", [("2021-05-01", 2.0)])
    with pytest.raises(Exception, match="lost"):
        build(fail=True)
    assert manifest.read_manifest(spark, out)["pending"] == [2021]
    os.remove(f"{raw}/b.csv")                                                         # and the part is withdrawn meanwhile
    assert build() == [("2020-05-01", 1.0), ("None", 7.0)]
    assert manifest.read_manifest(spark, out)["pending"] is None


def test_read_or_build_notices_inputs_parameters_and_half_written_folders(spark, tmp_path):
    raw, out, made = str(tmp_path / "raw"), str(tmp_path / "out"), []
    _write(raw, "a", [("2020-05-01", 1.0)])

    def build():
        made.append(1)
        return spark.read.option("header", True).csv(raw)

    def table(**kw):
        return read_or_build(spark, out, build, write_features, inputs=[f"{raw}/*.csv"], **kw).count()

    assert table() == 1 and table() == 1 and len(made) == 1
    _write(raw, "b", [("2020-05-02", 2.0)])
    assert table() == 2 and len(made) == 2
    assert table(params={"x": 1}) == 2 and len(made) == 3
    os.remove(f"{out}/{manifest.NAME}")                                               # ended before the commit
    assert table(params={"x": 1}) == 2 and len(made) == 4
    half = str(tmp_path / "half")
    os.makedirs(half)
    spark.range(3).write.mode("overwrite").parquet(half)
    os.remove(f"{half}/_SUCCESS")
    assert read_or_build(spark, half, build, write_features).count() == 2 and len(made) == 5
