"""Rule tables for disease risk and foliar feeding.

The numbers and texts below are fixed values: they must equal the
published agronomic rules the service applies, so they are stated plainly,
in their natural order, in one place.  The operators turn them into small
literal DataFrames (for joins and reports) and into column expressions (for
scoring); nothing else in the code repeats them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Disease rules.
#   temp_lo/temp_hi      outer temperature band (both ends included)
#   opt_lo/opt_hi        optimal band, only counted inside the outer band
#   band_pts/opt_pts     points for the outer / optimal band
#   hum_min/hum_pts      mean humidity >= hum_min
#   rainy_min/rainy_pts  rainy days (rain > 0.5) >= rainy_min
#   rain_over/rain_pts   30-row rain total > rain_over
#   warm_over/warm_pts   mean temperature > warm_over
#   months/month_pts     month of the window's last row in months
#   rec1_hi / rec1_lo    first recommendation when score >= 50 / below
# ---------------------------------------------------------------------------
DISEASES = [
    dict(disease="peacock_spot", name="Peacock Spot (Cycloconio)",
         temp_lo=10, temp_hi=25, opt_lo=15, opt_hi=22, band_pts=30, opt_pts=30,
         hum_min=70, hum_pts=20, rainy_min=3, rainy_pts=20,
         rain_over=None, rain_pts=0, warm_over=None, warm_pts=0,
         months=[3, 4, 5, 9, 10, 11], month_pts=10,
         description="Fungal disease causing leaf spots, defoliation. Optimal: 15-22°C with high humidity and prolonged leaf wetness.",
         rec1_hi="Apply copper fungicide before winter rains", rec1_lo="Monitor conditions",
         rec2="Ensure good canopy ventilation", rec3="Avoid overhead irrigation",
         best_treatment_time="Late October or early spring"),
    dict(disease="verticillium_wilt", name="Verticillium Wilt",
         temp_lo=15, temp_hi=28, opt_lo=18, opt_hi=25, band_pts=30, opt_pts=30,
         hum_min=None, hum_pts=0, rainy_min=5, rainy_pts=15,
         rain_over=50, rain_pts=25, warm_over=None, warm_pts=0,
         months=[], month_pts=0,
         description="Soil-borne fungus blocking water vessels. Thrives with mild temps + rain periods.",
         rec1_hi="Improve soil drainage", rec1_lo="Monitor soil moisture",
         rec2="Avoid planting after susceptible crops (cotton, tomatoes)",
         rec3="No chemical cure - focus on prevention",
         best_treatment_time="Prevention before planting"),
    dict(disease="olive_knot", name="Olive Knot (Tuberculosis)",
         temp_lo=5, temp_hi=25, opt_lo=10, opt_hi=20, band_pts=25, opt_pts=25,
         hum_min=60, hum_pts=25, rainy_min=None, rainy_pts=0,
         rain_over=30, rain_pts=10, warm_over=None, warm_pts=0,
         months=[12, 1, 2, 3, 4], month_pts=15,
         description="Bacterial disease causing tumors on branches. Favored by mild temps, humidity, and bark wounds.",
         rec1_hi="Remove tumors in summer (July-August) in dry conditions",
         rec1_lo="Remove tumors in summer (July-August) in dry conditions",
         rec2="Apply copper after pruning", rec3="Disinfect pruning tools",
         best_treatment_time="Summer for tumor removal, copper spray after pruning"),
    dict(disease="xylella", name="Xylella Fastidiosa",
         temp_lo=15, temp_hi=35, opt_lo=26, opt_hi=28, band_pts=20, opt_pts=40,
         hum_min=50, hum_pts=20, rainy_min=None, rainy_pts=0,
         rain_over=None, rain_pts=0, warm_over=20, warm_pts=20,
         months=[], month_pts=0,
         description="Deadly bacterial disease (OQDS). Optimal spread at 26-28°C via spittlebug vectors.",
         rec1_hi="Monitor for spittlebug vectors", rec1_lo="Monitor for spittlebug vectors",
         rec2="No cure - prevention critical", rec3="Report suspicious symptoms immediately",
         best_treatment_time="Vector control in spring-summer"),
    dict(disease="anthracnose", name="Anthracnose (Leprosy)",
         temp_lo=15, temp_hi=27, opt_lo=18, opt_hi=24, band_pts=25, opt_pts=25,
         hum_min=85, hum_pts=30, rainy_min=None, rainy_pts=0,
         rain_over=40, rain_pts=20, warm_over=None, warm_pts=0,
         months=[], month_pts=0,
         description="Fungal fruit rot. High humidity and rain favor fruit infection.",
         rec1_hi="Apply fungicide at first signs of rain in risky periods",
         rec1_lo="Apply fungicide at first signs of rain in risky periods",
         rec2="Remove infected fruit", rec3="Improve air circulation",
         best_treatment_time="Before rain events in spring-autumn"),
]

# ---------------------------------------------------------------------------
# Foliar feeding rules (temperature band, minimum humidity,
# best months, description), in their natural order.
# ---------------------------------------------------------------------------
FOLIAR = [
    dict(type="nitrogen_early_spring", temp_lo=10, temp_hi=20, humidity_min=50,
         best_months=[2, 3], description="Nitrogen for vegetative recovery and flower differentiation"),
    dict(type="boron_preflowering", temp_lo=12, temp_hi=22, humidity_min=55,
         best_months=[3, 4], description="Boron, zinc for flowering and fruit set"),
    dict(type="potassium_summer", temp_lo=20, temp_hi=32, humidity_min=40,
         best_months=[6, 7, 8], description="Potassium, magnesium for fruit growth"),
    dict(type="calcium_midsummer", temp_lo=18, temp_hi=30, humidity_min=45,
         best_months=[5, 6, 7], description="Calcium for fruit firmness and stress resistance"),
    dict(type="phosphorus_autumn", temp_lo=12, temp_hi=25, humidity_min=50,
         best_months=[9, 10, 11], description="Phosphorus for reserve replenishment"),
]

# Rainy-day and dry-week thresholds, overall-risk counts,
# foliar timing texts.
RAINY_DAY_MM = 0.5
DRY_WEEK_MM = 5.0
BEST_TIME_OF_DAY = "Early morning (6-9 AM) or late afternoon (5-7 PM)"
AVOID = "Midday heat (>30°C), strong wind, rain forecast within 24h"
NO_RAIN = "No rain"

DISEASE_RULE_SCHEMA = T.StructType([
    T.StructField("disease", T.StringType(), False),
    T.StructField("disease_order", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("rec1_hi", T.StringType(), False),
    T.StructField("rec1_lo", T.StringType(), False),
    T.StructField("rec2", T.StringType(), False),
    T.StructField("rec3", T.StringType(), False),
    T.StructField("best_treatment_time", T.StringType(), False),
])

FOLIAR_RULE_SCHEMA = T.StructType([
    T.StructField("type", T.StringType(), False),
    T.StructField("type_order", T.IntegerType(), False),
    T.StructField("temp_lo", T.DoubleType(), False),
    T.StructField("temp_hi", T.DoubleType(), False),
    T.StructField("humidity_min", T.DoubleType(), False),
    T.StructField("best_months", T.ArrayType(T.IntegerType(), False), False),
    T.StructField("description", T.StringType(), False),
])


def disease_rule_table(spark: SparkSession) -> DataFrame:
    """The five disease texts as a literal table (5 rows, fixed size)."""
    rows = [(d["disease"], i, d["name"], d["description"], d["rec1_hi"], d["rec1_lo"],
             d["rec2"], d["rec3"], d["best_treatment_time"]) for i, d in enumerate(DISEASES)]
    return spark.createDataFrame(rows, DISEASE_RULE_SCHEMA)


def foliar_rule_table(spark: SparkSession) -> DataFrame:
    """The five foliar rules as a literal table (5 rows, fixed size)."""
    rows = [(f["type"], i, float(f["temp_lo"]), float(f["temp_hi"]), float(f["humidity_min"]),
             list(f["best_months"]), f["description"]) for i, f in enumerate(FOLIAR)]
    return spark.createDataFrame(rows, FOLIAR_RULE_SCHEMA)
