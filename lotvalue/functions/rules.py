"""Segment rules as data, and the CASE expressions generated from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .columns import contains_any, strip_lower


@dataclass(frozen=True)
class CategoryRule:
    key: str
    name: str
    terms: tuple[str, ...]
    min_price: int
    max_price: int


@dataclass(frozen=True)
class MakeCategoryRule:
    key: str
    make: str
    category: str
    min_records: int = 500


# Category rules in match order, with their price ranges.
CATEGORY_RULES = (
    CategoryRule("tractors", "Tractors", ("tractors", "tractor"), 5_000, 500_000),
    CategoryRule("trucks_and_trailers", "Trucks and Trailers", ("trucks and trailers", "truck", "trailer"),
                 2_000, 300_000),
    CategoryRule("harvesting", "Harvesting", ("harvesting", "harvest", "combines", "combine"), 5_000, 600_000),
    CategoryRule("loaders_and_lifts", "Loaders and Lifts", ("loaders and lifts", "loader", "lift", "skid steer"),
                 3_000, 400_000),
    CategoryRule("construction", "Construction", ("construction", "excavator", "dozer", "backhoe"),
                 5_000, 500_000),
    CategoryRule("applicators", "Applicators", ("applicators", "applicator", "sprayer", "sprayers"),
                 5_000, 500_000),
)
OTHER = CategoryRule("other", "Other Equipment", (), 1_000, 500_000)
MIN_CATEGORY_RECORDS = 1_000

# Brand segments in match order, and the terms of each brand-level category.
MAKE_CATEGORY_RULES = (
    MakeCategoryRule("john-deere_tractors", "john-deere", "tractors"),
    MakeCategoryRule("john-deere_harvesting", "john-deere", "harvesting"),
    MakeCategoryRule("john-deere_planting", "john-deere", "planting"),
    MakeCategoryRule("john-deere_hay_forage", "john-deere", "hay and forage"),
    MakeCategoryRule("ford_trucks", "ford", "trucks and trailers"),
    MakeCategoryRule("ford_tractors", "ford", "tractors"),
    MakeCategoryRule("case-ih_tractors", "case-ih", "tractors"),
    MakeCategoryRule("case-ih_harvesting", "case-ih", "harvesting"),
    MakeCategoryRule("chevrolet_trucks", "chevrolet", "trucks and trailers"),
    MakeCategoryRule("new-holland_tractors", "new-holland", "tractors"),
    MakeCategoryRule("new-holland_hay_forage", "new-holland", "hay and forage"),
)
MAKE_CATEGORY_TERMS = {
    "tractors": ("tractor", "tractors"),
    "harvesting": ("harvesting", "harvest", "combines", "combine"),
    "trucks and trailers": ("trucks and trailers", "truck", "trailer"),
    "planting": ("planting", "planter", "planters"),
    "hay and forage": ("hay and forage", "hay", "forage", "baler"),
    "applicators": ("applicators", "applicator", "sprayer", "sprayers"),
    "tillage": ("tillage", "disk", "plow", "ripper"),
    "loaders and lifts": ("loaders and lifts", "loader", "lift", "skid steer"),
    "construction": ("construction", "excavator", "dozer", "backhoe"),
}

# Condition spellings, their grade, and the score of each grade.
CONDITION_GRADES = {
    "excellent": ("excellent", "like new"),
    "good": ("good", "very good"),
    "fair": ("fair", "average"),
    "poor": ("poor", "needs work", "salvage"),
}
CONDITION_SCORES = {"excellent": 5.0, "good": 4.0, "fair": 3.0, "poor": 2.0}
DEFAULT_CONDITION = "good"

# Horsepower segments of the tractor category (lower bound inclusive, price range).
HP_SEGMENTS = (
    ("tractors_compact", 0, 60, 5_000, 50_000),
    ("tractors_utility", 60, 150, 15_000, 150_000),
    ("tractors_rowcrop", 150, 600, 50_000, 500_000),
)


def _first_match(branches) -> Column:
    """CASE over (condition, value) pairs; the earliest true condition wins."""
    case = None
    for condition, value in branches:
        case = F.when(condition, value) if case is None else case.when(condition, value)
    return case


def category_key(raw_category: Column, rules=CATEGORY_RULES) -> Column:
    """Exclusive category: the first rule with a matching term, else 'other'."""
    return _first_match(
        (contains_any(raw_category, rule.terms), F.lit(rule.key)) for rule in rules
    ).otherwise(OTHER.key)


def category_memberships(raw_category: Column, rules=CATEGORY_RULES) -> Column:
    """Every category whose training filter accepts the row (a row may match several, or none)."""
    return F.array_compact(
        F.array(*[F.when(contains_any(raw_category, rule.terms), F.lit(rule.key)) for rule in rules])
    )


def category_name(key: Column, rules=CATEGORY_RULES) -> Column:
    return _first_match((key == rule.key, F.lit(rule.name)) for rule in rules).otherwise(OTHER.name)


def make_category_key(make: Column, category: Column, rules=MAKE_CATEGORY_RULES,
                      terms=MAKE_CATEGORY_TERMS) -> Column:
    """Brand-level segment: the exact key if one is spelled that way, else the first rule that matches."""
    brand, kind = strip_lower(make), strip_lower(category)
    spelled = F.concat(brand, F.lit("_"), F.replace(F.replace(kind, F.lit(" "), F.lit("_")), F.lit("and"), F.lit("")))
    exact = (spelled.isin([rule.key for rule in rules]), spelled)
    fuzzy = (
        ((brand == rule.make) & contains_any(kind, terms[rule.category]), F.lit(rule.key)) for rule in rules
    )
    return _first_match([exact, *fuzzy])


def condition_grade(raw_condition: Column) -> Column:
    text = strip_lower(raw_condition)
    return _first_match(
        (text.isin(*spellings), F.lit(grade)) for grade, spellings in CONDITION_GRADES.items()
    ).otherwise(DEFAULT_CONDITION)


def condition_score(grade: Column) -> Column:
    return _first_match(
        (grade == name, F.lit(score)) for name, score in CONDITION_SCORES.items()
    ).otherwise(CONDITION_SCORES[DEFAULT_CONDITION])


def hp_segment(horsepower: Column) -> Column:
    return _first_match(
        ((horsepower >= low) & (horsepower < high), F.lit(key)) for key, low, high, _, _ in HP_SEGMENTS
    )


def category_rules_table(spark, rules=CATEGORY_RULES):
    """The rules as a table, for joins with grouped results."""
    rows = [(r.key, r.name, r.min_price, r.max_price, MIN_CATEGORY_RECORDS) for r in (*rules, OTHER)]
    return spark.createDataFrame(rows, "category_key string, category_name string, min_price int, "
                                       "max_price int, min_records int")


def make_category_rules_table(spark, rules=MAKE_CATEGORY_RULES):
    rows = [(r.key, r.make, r.category, r.min_records) for r in rules]
    return spark.createDataFrame(rows, "make_category_key string, make_key string, category string, min_records int")
