"""Scalar column functions.  All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Limits, display maxima and precaution cards of the reference.
# ---------------------------------------------------------------------------

# Pollutant status limits (F8): pollutant -> (optimal up to, normal up to).
POLLUTANT_LIMITS = {
    "pm25": (25, 60),
    "pm10": (50, 100),
    "no2": (40, 80),
    "so2": (20, 80),
    "co": (4000, 10000),
    "o3": (100, 180),
}

# Display maxima for percentage bars.
SCALE_MAX = {
    "pm25": 250,
    "pm10": 500,
    "no2": 200,
    "so2": 200,
    "co": 20000,
    "o3": 300,
    "aqi": 500,
}

# Precaution cards by AQI band (F10): (upper bound, [(icon, title, desc), ...]).
PRECAUTIONS = [
    (50, [
        ("park", "Outdoor Safe", "All outdoor activities are safe. Enjoy the fresh air."),
        ("self_improvement", "No Restrictions", "No health precautions necessary."),
    ]),
    (100, [
        ("visibility", "Monitor Conditions", "Unusually sensitive people should consider limiting prolonged outdoor exertion."),
        ("air", "Ventilate Indoor", "Open windows to maintain indoor air circulation."),
    ]),
    (200, [
        ("masks", "Wear N95 Mask", "Use certified masks when outdoor exposure exceeds 30 min."),
        ("child_care", "Protect Children", "Keep children and elderly indoors during peak hours."),
        ("local_hospital", "Monitor Symptoms", "Watch for coughing, difficulty breathing, or eye irritation."),
        ("home", "Air Purifier", "Run indoor air purifiers and keep windows closed."),
    ]),
    (None, [
        ("emergency", "Stay Indoors", "Avoid ALL outdoor activity. Seal windows and doors."),
        ("masks", "N95 Mandatory", "If going outside is unavoidable, use N95/P100 respirators."),
        ("local_hospital", "Seek Medical Help", "People with respiratory conditions should contact their doctor."),
        ("water_drop", "Stay Hydrated", "Drink plenty of water to help your body flush toxins."),
    ]),
]

ALERT_FORMAT = "CRITICAL AIR QUALITY ALERT: %s AQI %d — %s"
REPORT_NAME_FORMAT = "report_summary_%s_%s.json"
EXPORT_NAME_FORMAT = "aqi_report_%s_%ddays.csv"
REVERSION_STEP = 0.15        # mean-reversion weight per forecast step (F12)
PROXY_FACTOR = 1.5           # historical AQI proxy factor (F14)

# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pollutant_status(v, low, high) -> Column:
    """F8: OPTIMAL up to ``low``, NORMAL up to ``high`` (inclusive), else ELEVATED."""
    v = _col(v)
    return (F.when(v <= F.lit(low), "OPTIMAL")
            .when(v <= F.lit(high), "NORMAL")
            .otherwise("ELEVATED"))


def scale_pct(v, max_value) -> Column:
    """``min(v / max * 100, 100)``."""
    mx = max_value if isinstance(max_value, Column) else F.lit(float(max_value))
    return F.least(_col(v) / mx * F.lit(100.0), F.lit(100.0))


def positive_or_missing(c) -> Column:
    """The value only when it is > 0 (the dashboard hides 0 and missing)."""
    c = _col(c)
    return F.when(c > 0, c)


def precautions(aqi) -> Column:
    """array<struct<icon, title, desc>> for the AQI band."""
    aqi = _col(aqi)

    def cards(items):
        return F.array(*[F.struct(F.lit(i).alias("icon"), F.lit(t).alias("title"),
                                  F.lit(d).alias("desc")) for i, t, d in items])

    expr = None
    for bound, items in PRECAUTIONS[:-1]:
        cond = aqi <= F.lit(float(bound))
        expr = F.when(cond, cards(items)) if expr is None else expr.when(cond, cards(items))
    return expr.otherwise(cards(PRECAUTIONS[-1][1]))


def js_round(x) -> Column:
    """Math.round: half up toward +infinity, as a long."""
    return F.floor(_col(x) + F.lit(0.5)).cast("long")


def alert_text(city, aqi, level) -> Column:
    """upper-case city, rounded AQI, level."""
    return F.format_string(ALERT_FORMAT, F.upper(_col(city)), js_round(aqi), _col(level))


def blend(raw, base, i) -> Column:
    """``raw*(1-w) + base*w`` with ``w = 0.15*(i+1)`` (code's rule, Q8)."""
    w = F.lit(REVERSION_STEP) * (_col(i) + F.lit(1)) if not isinstance(i, int) else F.lit(REVERSION_STEP * (i + 1))
    return _col(raw) * (F.lit(1.0) - w) + _col(base) * w


def parse_date(s, formats=("yyyy-MM-dd",)) -> Column:
    """first format that parses, else NULL (never raises under ANSI)."""
    s = _col(s)
    tries = [F.try_to_timestamp(s, F.lit(fmt)) for fmt in formats]
    return F.to_date(tries[0] if len(tries) == 1 else F.coalesce(*tries))


def aqi_proxy(pm10, no2) -> Column:
    """``max(pm10, no2) * 1.5``; one missing is skipped, both missing -> NULL."""
    return F.greatest(_col(pm10), _col(no2)) * F.lit(PROXY_FACTOR)


def minmax(x, lo, hi) -> Column:
    """``(x - min) / (max - min)``; a constant column scales to 0."""
    rng = _col(hi) - _col(lo)
    return (_col(x) - _col(lo)) / F.when(rng == 0, F.lit(1.0)).otherwise(rng)


def minmax_inverse(x, lo, hi) -> Column:
    """F15 inverse of :func:`minmax` (a constant column maps back to its value)."""
    rng = _col(hi) - _col(lo)
    return _col(x) * F.when(rng == 0, F.lit(1.0)).otherwise(rng) + _col(lo)


def date_text(d) -> Column:
    """F16: ``%Y-%m-%d``."""
    return F.date_format(_col(d), "yyyy-MM-dd")


def iso_ts(ts) -> Column:
    """F16: ISO-8601 with microseconds (UTC session)."""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def round2(x) -> Column:
    """two decimals."""
    return F.round(_col(x), 2)


def city_list(s) -> Column:
    """split on comma, trim, drop empty; order and duplicates kept."""
    parts = F.transform(F.split(_col(s), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != F.lit(""))


def report_name(city, ts) -> Column:
    """``report_summary_<city>_<yyyyMMdd_HHmmss>.json`` with blanks -> ``_``."""
    return F.replace(F.format_string(REPORT_NAME_FORMAT, _col(city),
                                     F.date_format(_col(ts), "yyyyMMdd_HHmmss")),
                     F.lit(" "), F.lit("_"))


def export_name(city, days) -> Column:
    """Name of the CSV export (K7)."""
    return F.format_string(EXPORT_NAME_FORMAT, _col(city), F.lit(int(days)))


def or_zero(x) -> Column:
    """missing -> 0 for display."""
    return F.coalesce(_col(x), F.lit(0.0))


def to_double(x) -> Column:
    """typed cast, bad text -> NULL."""
    return _col(x).try_cast("double")


def horizon_fallback(p24, p48, p72, tomorrow=None):
    """each horizon falls back to the one before it; 0 counts as missing.

    Returns three columns (aqi_24h, aqi_48h, aqi_72h).
    """
    def nz(c):
        return F.nullif(_col(c), F.lit(0.0))
    first = [nz(p24)] + ([nz(tomorrow)] if tomorrow is not None else [])
    a24 = F.coalesce(*first, F.lit(0.0))
    a48 = F.coalesce(nz(p48), a24)
    a72 = F.coalesce(nz(p72), a48)
    return a24.alias("aqi_24h"), a48.alias("aqi_48h"), a72.alias("aqi_72h")


def fmt(x, decimals: int = 1, missing: str = "N/A") -> Column:
    """fixed decimals text (half up, as the dashboard), ``missing`` if NULL."""
    x = _col(x)
    return F.when(x.isNull(), F.lit(missing)).otherwise(F.format_string(f"%.{int(decimals)}f", x))


def predictions_struct(p24, p48, p72) -> Column:
    """nested ``{24h: {aqi, health_risk}, 48h: ..., 72h: ...}`` with rounded AQI.

    The risk is taken on the unrounded value, as the reference classifies
    before rounding.
    """
    from .risk import health_risk
    return F.struct(*[F.struct(round2(c).alias("aqi"), health_risk(c).alias("health_risk")).alias(h)
                      for c, h in ((_col(p24), "24h"), (_col(p48), "48h"), (_col(p72), "72h"))])


def limits_table(spark):
    """F8/F9 limits as a 6-row table (pollutant, optimal_max, normal_max, display_max)."""
    rows = [(p, float(lo), float(hi), float(SCALE_MAX[p])) for p, (lo, hi) in POLLUTANT_LIMITS.items()]
    return spark.createDataFrame(rows, "pollutant string, optimal_max double, normal_max double, display_max double")
