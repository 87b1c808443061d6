"""The engine's own small catalogs: attributes, scenarios, facts beside the point, names and translations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: key, category, whether it may be required false, scenarios, text if true, text if false.
ATTRIBUTES = [
    ("drives", "ability", False, ["harbour", "museum"], "holds a driving licence", "does not drive"),
    ("swims", "ability", False, ["harbour"], "swims well", "cannot swim"),
    ("speaks_two", "ability", False, ["harbour", "museum", "orchard"], "speaks two languages", "speaks one language"),
    ("lifts", "ability", False, ["orchard", "harbour"], "lifts heavy crates", "cannot lift heavy crates"),
    ("first_aid", "qualification", False, ["harbour", "museum", "orchard"], "has a first-aid certificate", "has no first-aid certificate"),
    ("guide_exam", "qualification", False, ["museum"], "passed the guides' exam", "has not sat the guides' exam"),
    ("weekends", "availability", False, ["harbour", "museum", "orchard"], "is free at weekends", "is busy at weekends"),
    ("mornings", "availability", False, ["orchard", "harbour", "museum"], "can start before seven", "cannot start before seven"),
    ("outdoors", "preference", False, ["orchard", "harbour"], "likes working outdoors", "prefers to work indoors"),
    ("evenings", "availability", False, ["museum", "orchard"], "can stay late", "has to leave early"),
    ("pollen", "restriction", True, ["orchard", "museum"], "is allergic to pollen", "has no allergy to pollen"),
    ("seasick", "restriction", True, ["harbour", "orchard"], "gets seasick", "never gets seasick"),
]
#: key, title, categories allowed, keys allowed (null: all).
SCENARIOS = [
    ("harbour", "A helper for the ferry", ["ability", "qualification", "availability", "preference", "restriction"], None),
    ("museum", "A guide for the gallery", ["ability", "qualification", "availability", "restriction"], None),
    ("orchard", "A hand for the harvest", ["ability", "qualification", "availability", "preference", "restriction"], ["speaks_two", "lifts", "first_aid", "weekends", "mornings", "outdoors", "evenings", "pollen", "seasick"]),
]
#: key, category, text, scenarios that it belongs to.
FACTS = [
    ("chess", "hobby", "plays chess on Thursdays", ["harbour", "museum", "orchard"]),
    ("cat", "home", "lives with an old cat", ["harbour", "museum"]),
    ("tea", "taste", "drinks only green tea", ["museum", "orchard"]),
    ("trains", "hobby", "collects model trains", ["harbour", "museum", "orchard"]),
    ("attic", "home", "rents a room under the roof", ["harbour", "orchard"]),
    ("blue", "taste", "wears blue most of the time", ["harbour", "museum", "orchard"]),
]
NAMES = ["Ada", "Bela", "Ciro", "Dana", "Eero", "Fay", "Gus", "Hana", "Igor", "Juno", "Kai", "Lena"]
TRANSLATIONS = {("drives", True): "会开车", ("drives", False): "不会开车", ("swims", True): "会游泳", ("swims", False): "不会游泳", ("weekends", True): "周末有空", ("weekends", False): "周末没空"}


def attributes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ATTRIBUTES, "key string, category string, may_be_false boolean, scenarios array<string>, text_true string, text_false string")


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCENARIOS, "scenario string, title string, categories array<string>, keys array<string>")


def facts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FACTS, "key string, category string, text string, scenarios array<string>")


def translations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v, t) for (k, v), t in TRANSLATIONS.items()], "key string, value boolean, text string")


def values_sql(rows: list[tuple]) -> str:
    """The rows as a DuckDB VALUES list."""

    def show(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(map(show, x)) + "]"
        return "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return "VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)
