"""Small dimensions: sections, topics, prices, stop words. Values that results depend on are fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: fixed values: sections in their order, with their names
CORE_NAMES = {
    "C01": "Overview & Scope",
    "C02": "Philosophy & Core Principles",
    "C03": "Integral Model",
    "C04": "Mechanisms",
    "C05": "Glossary",
    "C06": "Quantitative Reference",
    "C07": "Testing & Assessment",
    "C08": "Methodology & Progression",
    "C09": "Decision Rules & Heuristics",
    "C10": "Applied Guidance",
    "C11": "Recovery, Monitoring & Lifestyle",
    "C12": "Adaptations by Population / Context",
    "C13": "Contraindications, Cautions & Safety Limits",
    "C14": "Formulas & Calculations",
    "C15": "Evidence & Key References",
    "C16": "Notable Statements",
    "C17": "Validity Notes",
    "C18": "Library Index",
}
LIBRARY_NAMES = {
    "L1": "Plans & Programs",
    "L2": "Workouts & Protocols",
    "L3": "Exercises & Technique",
    "L4": "Recipes, Menus & Meal Plans",
    "L5": "Worksheets, Questionnaires & Templates",
}
CORE, LIBRARY = list(CORE_NAMES), list(LIBRARY_NAMES)
SECTIONS = CORE + LIBRARY
#: fixed values: destinations that aren't sections, and all that an entry may have
PSEUDO = ["SUMMARY", "LOG", "DELETE"]
VALID = SECTIONS + PSEUDO
FALLBACK = "C10"
#: fixed values: sections whose entries should carry topics
TOPIC_SECTIONS = ["C06", "C09", "C10", "C12", "C13", "C14"]
#: topics that the derived entries may carry; a vocabulary text gives them in use
TOPICS = ["renal", "diabetes", "sop", "general"]
#: (model, valid from, input, output, cache read factor), prices for a million tokens
PRICES = [("m0", "2023-01-01", 3.0, 15.0, 0.1), ("m1", "2023-01-01", 1.0, 5.0, 0.1), ("m1", "2024-01-15", 2.0, 10.0, 0.2)]
DEFAULT_PRICE = (5.0, 25.0, 0.1)
CACHE_WRITE_FACTOR, BATCH_FACTOR, TTL_SECONDS = 2.0, 0.5, 3300
#: fixed values: frequent words of legible English and Spanish text
STOP_WORDS = (
    "the and of to in is for with on are be as or by that this it at an from not can may should was were has have if but more than your "
    "you their which also per day de la el en los las que del se por con para una un es al lo como su sus le les no si mas más pero"
).split()


def sections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, i, "core" if c in CORE else "library") for i, c in enumerate(SECTIONS)], "code string, ord int, kind string")


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, valid_from string, p_in double, p_out double, r_mult double").withColumn("valid_from", F.col("valid_from").cast("timestamp_ntz"))


def sql_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"

