"""Risk scales and label maps as native Column expressions.

Every scale is a list of (inclusive upper bound, value...) bands; the last band
has no bound and also catches NULL, because every comparison with NULL is
false (quirk Q2).  Callers that must not label missing AQI filter it first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These texts, colours and bounds must equal the reference's.
# ---------------------------------------------------------------------------

# US scale (F1): bound, level, colour, advice.
US_SCALE = [
    (50, "Good", "#00e400", "Air quality is satisfactory. Enjoy outdoor activities."),
    (100, "Moderate", "#ffff00", "Acceptable. Sensitive individuals should limit prolonged outdoor exertion."),
    (150, "Unhealthy for Sensitive Groups", "#ff7e00", "People with asthma or heart conditions should reduce outdoor activity."),
    (200, "Unhealthy", "#ff0000", "Everyone may experience health effects. Wear N95 mask outdoors."),
    (300, "Very Unhealthy", "#8f3f97", "Health alert: significant risk. Avoid all outdoor exertion."),
    (None, "Hazardous", "#7e0023", "Emergency conditions. Stay indoors. Keep windows sealed."),
]

# Dashboard scale (F2): bound, short level, colour, badge.
DISPLAY_SCALE = [
    (50, "Good", "#00e400", "Safe Range"),
    (100, "Moderate", "#ffff00", "Acceptable"),
    (150, "Unhealthy (S)", "#ff7e00", "Caution"),
    (200, "Unhealthy", "#ff0000", "Warning"),
    (300, "Very Unhealthy", "#8f3f97", "Danger"),
    (None, "Hazardous", "#7e0023", "Emergency"),
]

# Indian 6-level scale (F3): bound, level.
INDIA_SCALE = [
    (50, "Good"),
    (100, "Satisfactory"),
    (200, "Moderate"),
    (300, "Poor"),
    (400, "Very Poor"),
    (None, "Severe"),
]

# Classifier 4-class scale (F4): bound, class.
BUCKET4_SCALE = [
    (50, "Good"),
    (100, "Moderate"),
    (200, "Unhealthy"),
    (None, "Hazardous"),
]

# Recommendation per Indian level (F5), and the default for anything else.
RECOMMENDATIONS = {
    "Good": "Air quality is favorable. Outdoor activities are safe.",
    "Satisfactory": "Air quality is acceptable. Sensitive groups should monitor prolonged exposure.",
    "Moderate": "Limit heavy outdoor exertion, especially for children and elderly.",
    "Poor": "Wear a mask outdoors and avoid long exposure in traffic-heavy areas.",
    "Very Poor": "Avoid outdoor exercise. Use air purifiers indoors if possible.",
    "Severe": "Health emergency conditions. Stay indoors and minimize all outdoor activity.",
}
DEFAULT_RECOMMENDATION = "Monitor AQI closely and follow health advisories."

# Classifier class -> Indian display label (F6); unknown labels pass unchanged.
DISPLAY_LABELS = {
    "Good": "Good",
    "Moderate": "Satisfactory",
    "Unhealthy": "Poor",
    "Hazardous": "Severe",
}

# Bucket name -> 4 classes (F7); unknown labels pass unchanged.
BUCKET_TO_CLASS = {
    "Good": "Good",
    "Satisfactory": "Moderate",
    "Moderate": "Moderate",
    "Poor": "Unhealthy",
    "Very Poor": "Hazardous",
    "Severe": "Hazardous",
    "Unhealthy": "Unhealthy",
    "Hazardous": "Hazardous",
}

# The four classes the classifier keeps, in the reference's order.
CLASS_LABELS = ["Good", "Moderate", "Unhealthy", "Hazardous"]

# ---------------------------------------------------------------------------

SCALES = {"us": US_SCALE, "display": DISPLAY_SCALE, "india": INDIA_SCALE, "bucket4": BUCKET4_SCALE}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def band(aqi, scale, field: int = 1) -> Column:
    """``CASE WHEN aqi <= b1 THEN v1 ... ELSE v_last END`` for one field of a scale."""
    aqi = _col(aqi)
    expr = None
    for row in scale[:-1]:
        cond = aqi <= F.lit(float(row[0]))
        expr = F.when(cond, F.lit(row[field])) if expr is None else expr.when(cond, F.lit(row[field]))
    return expr.otherwise(F.lit(scale[-1][field]))


def risk_level(aqi, scale: str = "us") -> Column:
    """Level name of ``aqi`` on one of the four named scales (Q3)."""
    return band(aqi, SCALES[scale], 1)


def health_risk(aqi) -> Column:
    """US scale as ``struct(level, color, advice)``."""
    return F.struct(band(aqi, US_SCALE, 1).alias("level"),
                    band(aqi, US_SCALE, 2).alias("color"),
                    band(aqi, US_SCALE, 3).alias("advice"))


def risk_display(aqi) -> Column:
    """dashboard scale as ``struct(level, color, badge)``."""
    return F.struct(band(aqi, DISPLAY_SCALE, 1).alias("level"),
                    band(aqi, DISPLAY_SCALE, 2).alias("color"),
                    band(aqi, DISPLAY_SCALE, 3).alias("badge"))


def risk_india(aqi) -> Column:
    """Indian 6-level scale."""
    return band(aqi, INDIA_SCALE, 1)


def risk_bucket4(aqi) -> Column:
    """classifier 4-class scale."""
    return band(aqi, BUCKET4_SCALE, 1)


def _lookup(mapping: dict, key) -> Column:
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(m, _col(key))


def recommendation(level) -> Column:
    """advice text for an Indian level, with the default for anything else."""
    return F.coalesce(_lookup(RECOMMENDATIONS, level), F.lit(DEFAULT_RECOMMENDATION))


def display_label(label) -> Column:
    """classifier label -> Indian label; unknown labels unchanged."""
    return F.coalesce(_lookup(DISPLAY_LABELS, label), _col(label))


def normalise_label(label) -> Column:
    """8 bucket names -> 4 classes; unknown labels unchanged (NULL stays NULL)."""
    return F.coalesce(_lookup(BUCKET_TO_CLASS, label), _col(label))
