from pyspark.sql import functions as F

from lotvalue.functions import rules


def test_first_rule_wins_but_training_filters_overlap(spark):
    df = spark.createDataFrame([("Truck Tractor",), ("Loaders and Lifts",), ("Hay and Forage",), ("Misc",), (None,)],
                               "raw_category string")
    out = df.select(rules.category_key(F.col("raw_category")),
                    rules.category_memberships(F.col("raw_category"))).collect()
    assert [r[0] for r in out] == ["tractors", "loaders_and_lifts", "other", "other", "other"]
    assert [r[1] for r in out] == [["tractors", "trucks_and_trailers"], ["loaders_and_lifts"], [], [], []]


def test_brand_segments_exact_then_fuzzy(spark):
    cases = [
        (" John-Deere ", "Tractors", "john-deere_tractors"),
        ("john-deere", "hay_forage", "john-deere_hay_forage"),       # spelled exactly like the key
        ("john-deere", "Hay and Forage", "john-deere_hay_forage"),   # 'hay__forage' is no key: fuzzy
        ("ford", "Trucks", "ford_trucks"),
        ("ford", "Truck Tractor", "ford_trucks"),                    # first rule in order
        ("john-deere", "Truck", None),
        ("kubota", "Tractors", None),
        (None, "Tractors", None),
        ("ford", None, None),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "make string, cat string")
    out = df.select(rules.make_category_key(F.col("make"), F.col("cat"))).collect()
    assert [r[0] for r in out] == [c[2] for c in cases]


def test_condition(spark):
    cells = ["Like New", " VERY GOOD", "average", "salvage", "unknown", None, "needs work"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    grade = rules.condition_grade(F.col("c"))
    out = df.select(grade, rules.condition_score(grade)).collect()
    assert [r[0] for r in out] == ["excellent", "good", "fair", "poor", "good", "good", "poor"]
    assert [r[1] for r in out] == [5.0, 4.0, 3.0, 2.0, 4.0, 4.0, 2.0]


def test_names_and_segments(spark):
    df = spark.createDataFrame([("harvesting", 59.9), ("nope", 60.0), ("other", 150.0), ("tractors", 600.0)],
                               "k string, hp double")
    out = df.select(rules.category_name(F.col("k")), rules.hp_segment(F.col("hp"))).collect()
    assert [r[0] for r in out] == ["Harvesting", "Other Equipment", "Other Equipment", "Tractors"]
    assert [r[1] for r in out] == ["tractors_compact", "tractors_utility", "tractors_rowcrop", None]
