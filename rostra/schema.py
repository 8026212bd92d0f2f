"""Tables, measures and the fixed dimension values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DIMS6 = ["people_centrism", "anti_elitism", "moral_dichotomy", "popular_sovereignty", "exclusionary_rhetoric", "crisis_rhetoric"]
M7 = [*DIMS6, "final_score"]
INVALID = "INVALID"
#: Inclusive default range of years of a distribution.
YEARS = (2000, 2025)

DISCOURSES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("iso3", T.StringType()),
        T.StructField("leader_name", T.StringType()),
        T.StructField("discourse_year", T.IntegerType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("word_count", T.IntegerType()),
    ]
)
SCORES = T.StructType([T.StructField("discourse_id", T.StringType(), False), *[T.StructField(m, T.DoubleType()) for m in M7], T.StructField("n_chunks", T.IntegerType())])
#: What a pre-joined table must hold; n_chunks and word_count may be missing.
WEB_DATA = T.StructType([*[T.StructField(m, T.DoubleType()) for m in M7], *[T.StructField(c, T.StringType()) for c in ("iso3", "leader_name", "dtype")], T.StructField("year", T.IntegerType())])
# The columns of a published export, without text.
EXPORT = ["discourse_id", "iso3", "country", "leader_name", "year", "discourse_type", "word_count", "n_chunks", *M7, "model_id", "scored_at"]

# Country labels by code.
COUNTRY_NAMES = {
    "ARG": "Argentina",
    "BOL": "Bolivia",
    "BRA": "Brazil",
    "CHL": "Chile",
    "COL": "Colombia",
    "CRI": "Costa Rica",
    "CUB": "Cuba",
    "DOM": "Dom. Republic",
    "ECU": "Ecuador",
    "GTM": "Guatemala",
    "HND": "Honduras",
    "MEX": "Mexico",
    "NIC": "Nicaragua",
    "PAN": "Panama",
    "PER": "Peru",
    "PRY": "Paraguay",
    "SLV": "El Salvador",
    "URY": "Uruguay",
    "VEN": "Venezuela",
}
# Latitude and longitude of a country's label.
CENTROIDS = {
    "ARG": (-34, -64),
    "BOL": (-17, -65),
    "BRA": (-14, -51),
    "CHL": (-35, -71),
    "COL": (4, -72),
    "CRI": (10, -84),
    "CUB": (22, -79),
    "DOM": (19, -70),
    "ECU": (-2, -78),
    "GTM": (15, -90),
    "HND": (15, -87),
    "MEX": (23, -102),
    "NIC": (13, -85),
    "PAN": (9, -80),
    "PER": (-10, -76),
    "PRY": (-23, -58),
    "SLV": (14, -89),
    "URY": (-33, -56),
    "VEN": (7, -66),
}
# Measure labels in Portuguese and English.
MEASURE_LABELS = {
    "final_score": ("Score Final", "Final Score"),
    "people_centrism": ("Povo-Centrismo", "People Centrism"),
    "anti_elitism": ("Anti-Elitismo", "Anti-Elitism"),
    "moral_dichotomy": ("Dicotomia Moral", "Moral Dichotomy"),
    "popular_sovereignty": ("Soberania Popular", "Popular Sovereignty"),
    "exclusionary_rhetoric": ("Retórica Excludente", "Exclusionary Rhetoric"),
    "crisis_rhetoric": ("Retórica de Crise", "Crisis Rhetoric"),
}
# Fixed values: (score, red, green, blue) of the colour scale; the light theme differs in the first stop.
STOPS_DARK = [(0, 26, 20, 16), (22, 93, 122, 90), (50, 201, 140, 58), (72, 184, 80, 66), (100, 138, 51, 40)]
STOPS_LIGHT = [(0, 243, 234, 217), *STOPS_DARK[1:]]
# Colours of growth and of decline.
SIGN_COLORS = ("#F87171", "#4ADE80")
# How many groups a view holds at least and at most.
CHOSEN_RADAR = (1, 7)
CHOSEN_SERIES = (1, None)
# Lower ends of the bands Low, Moderate, High and Very High; each holds its lower end.
BANDS = [(0, "Low"), (30, "Moderate"), (50, "High"), (65, "Very High")]


def dim_country(spark: SparkSession) -> DataFrame:
    """iso3, name, lat and lon: 19 rows."""
    rows = [(k, v, float(CENTROIDS[k][0]), float(CENTROIDS[k][1])) for k, v in COUNTRY_NAMES.items()]
    return spark.createDataFrame(rows, "iso3 string, name string, lat double, lon double")


def dim_measure(spark: SparkSession) -> DataFrame:
    """key, pt and en: 7 rows."""
    return spark.createDataFrame([(k, *v) for k, v in MEASURE_LABELS.items()], "key string, pt string, en string")
