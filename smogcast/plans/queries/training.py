"""Registered queries for classifier preparation: labels, sampling, split, weights and
fitted preprocessing (M7, M8, M10, J7, A11, A12, A15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import classify as cl
from .. import oracle as O
from ...functions import risk
from .registry import master, register


# ------------------------------------------------------------------ M10, A15, M7, M8, J7, A11, A12

TRAIN_KEY_SQL = "city || '|' || strftime(date, '%Y-%m-%d')"
TRAIN_CTES = [
    ("prepared", f"SELECT {TRAIN_KEY_SQL} AS row_key, pm25, pm10, no2, so2, co, o3, city, "
                 + O.sql_lookup("aqi_bucket", risk.BUCKET_TO_CLASS, "aqi_bucket") + " AS label FROM master"),
    ("labeled", "SELECT * FROM prepared WHERE label IN ('Good', 'Moderate', 'Unhealthy', 'Hazardous')"),
]
SAMPLE_MAX = 3000


def _training(spark, sf_dir):
    return cl.prepare_training(master(spark, sf_dir))[0]


@register("prepare_training", O.with_ctes(O.finish("SELECT * FROM labeled",
                                                   ["pm25", "pm10", "no2", "so2", "co", "o3"]),
                                          "master", extra=TRAIN_CTES))
def q_prepare_training(spark, sf_dir):
    return _training(spark, sf_dir)


@register("class_fractions", O.with_ctes(O.finish(
    "SELECT label, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM labeled GROUP BY label",
    ["share"]), "master", extra=TRAIN_CTES))
def q_class_fractions(spark, sf_dir):
    return cl.class_fractions(_training(spark, sf_dir))


@register("stratified_sample", O.with_ctes(
    "SELECT row_key, label FROM (SELECT l.*, row_number() OVER (PARTITION BY l.label ORDER BY md5('42:' || l.row_key), "
    "l.row_key) AS rk, q.quota FROM labeled l JOIN (SELECT label, round_even("
    f"({SAMPLE_MAX} / (SELECT count(*) FROM labeled)) * count(*), 0) AS quota FROM labeled GROUP BY label) q "
    "ON l.label = q.label) WHERE rk <= quota", "master", extra=TRAIN_CTES))
def q_stratified_sample(spark, sf_dir):
    return cl.stratified_sample(_training(spark, sf_dir), max_rows=SAMPLE_MAX).select("row_key", "label")


HASH_UNIT_SQL = "CAST(('0x' || substr(md5('42:' || row_key), 1, 13)) AS BIGINT) / 4503599627370496.0"


def _alloc_sql(name, src, col, n_expr):
    """Largest-remainder allocation of ``n_expr`` draws over the classes of ``src`` by ``col``."""
    return [
        (f"{name}_c", f"SELECT label, {col} AS k, {col} * ({n_expr}) / sum({col}) OVER () AS cont FROM {src}"),
        (f"{name}_f", f"SELECT *, floor(cont) AS fl FROM {name}_c"),
        (f"{name}_r", f"SELECT *, ({n_expr}) - sum(fl) OVER () AS need, "
                      f"row_number() OVER (ORDER BY cont - fl DESC, label) AS rr FROM {name}_f"),
        (name, f"SELECT label, k, CAST(fl AS BIGINT) + CASE WHEN rr <= need THEN 1 ELSE 0 END AS q FROM {name}_r"),
    ]


SPLIT_QUOTA_CTES = (
    [("split_counts", "SELECT label, count(*) AS cnt FROM labeled GROUP BY label"),
     ("split_tot", "SELECT sum(cnt) AS n, CAST(ceil(CAST(0.2 AS DOUBLE) * sum(cnt)) AS BIGINT) AS n_test "
                   "FROM split_counts")]
    + _alloc_sql("alloc_train", "split_counts", "cnt", "(SELECT n - n_test FROM split_tot)")
    + [("split_rest", "SELECT label, k - q AS rest FROM alloc_train")]
    + _alloc_sql("alloc_test", "split_rest", "rest", "(SELECT n_test FROM split_tot)")
    + [("split", "SELECT l.*, CASE WHEN row_number() OVER (PARTITION BY l.label ORDER BY md5('42:' || l.row_key), "
                 "l.row_key) <= a.q THEN 'test' ELSE 'train' END AS part FROM labeled l "
                 "JOIN alloc_test a ON l.label = a.label")])


@register("stratified_split", O.with_ctes("SELECT row_key, label, part FROM split", "master",
                                          extra=TRAIN_CTES + SPLIT_QUOTA_CTES))
def q_stratified_split(spark, sf_dir):
    return cl.stratified_split(_training(spark, sf_dir)).select("row_key", "label", "part")


@register("stratified_split_hash", O.with_ctes(
    f"SELECT row_key, label, CASE WHEN {HASH_UNIT_SQL} < 0.2 THEN 'test' ELSE 'train' END AS part FROM labeled",
    "master", extra=TRAIN_CTES))
def q_stratified_split_hash(spark, sf_dir):
    """M8 for unbounded inputs: per-row Bernoulli split by hash fraction (no shuffle)."""
    return cl.stratified_split(_training(spark, sf_dir), exact=False).select("row_key", "label", "part")


SPLIT_CTES = TRAIN_CTES + SPLIT_QUOTA_CTES + [("train_rows", "SELECT * FROM split WHERE part = 'train'")]


@register("class_weights", O.with_ctes(O.finish(
    "SELECT label, count(*) AS n, (SELECT count(*) FROM train_rows) / ((SELECT count(DISTINCT label) FROM train_rows) "
    "* count(*)) AS weight FROM train_rows GROUP BY label", ["weight"]), "master", extra=SPLIT_CTES))
def q_class_weights(spark, sf_dir):
    t = cl.stratified_split(_training(spark, sf_dir)).where(F.col("part") == "train")
    w = cl.with_class_weights(t)
    return w.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.first("weight").alias("weight"))


IMPUTE_NUMERIC = ["pm25", "pm10", "no2", "so2", "co", "o3"]


@register("fit_impute", O.with_ctes(O.finish(
    "SELECT " + ", ".join(f"median({c}) AS {c}" for c in IMPUTE_NUMERIC) +
    ", (SELECT city FROM train_rows WHERE city IS NOT NULL GROUP BY city ORDER BY count(*) DESC, city LIMIT 1) AS city "
    "FROM train_rows", IMPUTE_NUMERIC), "master", extra=SPLIT_CTES))
def q_fit_impute(spark, sf_dir):
    t = cl.stratified_split(_training(spark, sf_dir)).where(F.col("part") == "train")
    return cl.fit_impute(t, IMPUTE_NUMERIC, ["city"])


@register("fit_standard", O.with_ctes(O.finish(
    "SELECT " + ", ".join(f"avg({c}) AS {c}__mean, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END "
                         f"AS {c}__std" for c in IMPUTE_NUMERIC) +
    " FROM (SELECT " + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM train_rows)) AS {c}" for c in IMPUTE_NUMERIC)
    + " FROM train_rows)", [f"{c}__{k}" for c in IMPUTE_NUMERIC for k in ("mean", "std")]),
    "master", extra=SPLIT_CTES))
def q_fit_standard(spark, sf_dir):
    t = cl.stratified_split(_training(spark, sf_dir)).where(F.col("part") == "train")
    imp = cl.fit_impute(t, IMPUTE_NUMERIC, ["city"])
    return cl.fit_standard(cl._impute_only(t, imp, IMPUTE_NUMERIC, ["city"]), IMPUTE_NUMERIC)
