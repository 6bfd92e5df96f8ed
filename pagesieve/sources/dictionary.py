"""The spam dictionary: phrases with weights.

The phrase list is a parameter: pass a list, or point ``read_dictionary`` at a file or table. A phrase without an
explicit weight gets ``DEFAULT_WEIGHT``; a phrase listed twice counts once; matching ignores case.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.schemas import DICTIONARY

DEFAULT_WEIGHT = 1
# Past this many phrases a dictionary is matched by a join instead of by literals in the plan.
MAX_LITERAL_PHRASES = 2000

# Phrases whose weight is not the default.
EXPLICIT_WEIGHTS = {
    "malware detected": 3,
    "virus detected": 3,
    "hacker detected": 2,
    "earn money fast": 2,
    "congratulations you won": 3,
    "free gift": 3,
    "free money": 2,
    "free movies": 3,
    "free crypto": 3,
    "free bitcoin": 3,
    "free robux": 3,
    "free cheats": 3,
    "free hacks": 3,
    "free spins": 3,
    "instant payout": 2,
    "xxx": 2,
    "porn": 3,
    "in your area": 2,
    "cams": 2,
    "horny": 3,
    "milf": 2,
    "hentai": 2,
    "gangbang": 4,
    "pussy": 2,
    "cock": 2,
    "tits": 2,
    "orgy": 2,
    "bukkake": 4,
    "bondage": 3,
    "jerk off": 3,
    "cum": 3,
    "credit repair": 2,
    "cialis": 2,
    "viagra": 2,
    "cash bonus": 3,
    "jackpot": 2,
    "human growth hormone": 3,
    "pure profit": 2,
    "risk-free": 2,
    "make money online": 4,
    "lottery winner": 2,
    "no strings attached": 3,
    "you have been selected": 2,
    "lose weight": 2,
    "miracle cure": 2,
    "this isn't a scam": 2,
    "this isn't junk": 2,
    "this isn't spam": 2,
    "enlargement": 2,
    "free vacation": 2,
    "you have won": 3,
    "you win": 3,
    "ozempic": 2,
}


def build_dictionary(
    phrases: Iterable[str],
    weights: Mapping[str, int] = EXPLICIT_WEIGHTS,
    default_weight: int = DEFAULT_WEIGHT,
) -> dict[str, int]:
    """``{lower-case phrase: weight}``, each distinct phrase once."""
    built: dict[str, int] = {}
    for phrase in phrases:
        if phrase:  # of phrases that differ in case only, the largest weight counts, as in read_dictionary
            built[phrase.lower()] = max(weights.get(phrase, default_weight), built.get(phrase.lower(), 0))
    return built


def dictionary_table(spark: SparkSession, dictionary: Mapping[str, int]) -> DataFrame:
    return spark.createDataFrame(list(dictionary.items()), DICTIONARY)


def read_dictionary(
    spark: SparkSession,
    phrases_path: str,
    weights_path: str | None = None,
    default_weight: int = DEFAULT_WEIGHT,
) -> DataFrame:
    """A dictionary table from a text file with one phrase per line and an optional ``phrase,weight`` CSV file."""
    phrases = spark.read.text(phrases_path).select(F.col("value").alias("phrase")).where("phrase <> ''").distinct()
    if weights_path is None:
        given = dictionary_table(spark, EXPLICIT_WEIGHTS)
    else:
        given = spark.read.schema(DICTIONARY).csv(weights_path)
    return (
        phrases.join(given, "phrase", "left")
        .groupBy(F.lower("phrase").alias("phrase"))
        .agg(F.max(F.coalesce("weight", F.lit(default_weight))).cast("int").alias("weight"))
    )


def as_literals(dictionary: DataFrame) -> dict[str, int]:
    """A small dictionary table as a mapping for the literal matcher; refuses one past ``MAX_LITERAL_PHRASES``."""
    rows = dictionary.select("phrase", "weight").limit(MAX_LITERAL_PHRASES + 1).collect()
    if len(rows) > MAX_LITERAL_PHRASES:
        raise ValueError("dictionary too large for literals: score it with operators.spam.spam_scores_by_join")
    return {row.phrase: row.weight for row in rows}
