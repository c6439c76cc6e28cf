"""URL filters: rules by host and path, and boosted trees on lexical features for the rest."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Tables

#: Labelled URLs, at most (in expectation, by a hash of the URL), that the trees are trained on.
FIT_ROWS = 50_000
ROUNDS, DEPTH = 12, 4
#: Pseudo-counts that a suffix starts with.
SMOOTH = 20.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^(?s)([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^(?s)[^/?#]*([^?#]*)", 1), F.lit(""))


def _count(text: Column, *parts: str) -> Column:
    kept = text
    for part in parts:
        kept = F.replace(kept, F.lit(part), F.lit(""))
    return (F.length(text) - F.length(kept)).cast("double")


def _entropy(text: Column) -> Column:
    size = F.length(text).cast("double")
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0),
                       lambda s, c: s - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))


FEATURES = ["length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_share", "entropy",
            "host_entropy", "parameters", "marks", "suffix_rate", "suffix_weight"]


def lexical(urls: DataFrame) -> DataFrame:
    """The lexical features of a frame with url, host and path."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    return urls.withColumns({
        "suffix": F.element_at(F.split(host, r"\."), -1),
        "length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"), "depth": _count(path, "/"), "labels": _count(host, "."),
        "hyphens": _count(host, "-"), "digit_share": digits / F.greatest(F.length(url), F.lit(1)),
        "entropy": _entropy(url), "host_entropy": _entropy(host), "parameters": _count(url, "&", "="),
        "marks": _count(url, "%", "_", "~", "+")})


#: So many rules, and labels of the longest one's host, are broadcast; more rules are joined by host.
SMALL_RULES, SMALL_LABELS = 10_000, 8
#: Shares that a host's rows are dealt in where rules are joined by host.
SALTS = 16


def _last_labels(host: Column, count) -> Column:
    """The last ``count`` labels of a host; null if it has fewer."""
    labels = F.split(host, r"\.")
    return F.when(F.size(labels) >= count, F.substring_index(host, ".", -count))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (with host and path) with ``rule`` and ``action`` of the longest rule that fits, else null.

    A rule (host, path, action) fits its host and all subdomains, if the path
    starts with the rule's.  Only as many parent domains of a host are looked at as
    the longest rule has labels.  Few rules are broadcast and joined once for each
    number of labels, without moving a URL; else each distinct host is looked up
    once and joined back in SALTS shares, so a host with a third of all pages is
    not one task's.
    """
    own = rules.where("host is not null and path is not null").select(F.col("host").alias("domain"), F.struct(
        F.length(F.concat("host", "path")).alias("n"), F.concat("host", "path").alias("rule"),
        F.col("path").alias("path"), "action").alias("found"))
    own = own.groupBy("domain").agg(F.collect_set("found").alias("fits"))
    count, most = rules.agg(F.count("*"), F.max(F.size(F.split("host", r"\.")))).first()
    most = most or 0
    best = lambda fits: F.array_max(F.filter(fits, lambda r: F.col("path").startswith(r["path"])))
    if count <= SMALL_RULES and most <= SMALL_LABELS:
        for k in range(1, most + 1):
            of_k = own.where(F.size(F.split("domain", r"\.")) == k).select(
                F.col("domain").alias(f"domain{k}"), F.col("fits").alias(f"fits{k}"))
            urls = urls.withColumn(f"domain{k}", _last_labels(F.col("host"), k)).join(F.broadcast(of_k), f"domain{k}", "left")
        none = F.lit(None).cast("struct<n:int,rule:string,path:string,action:string>")
        found = F.array_max(F.array(none, *[best(f"fits{k}") for k in range(1, most + 1)]))
        return urls.withColumn("best", found).withColumns({"rule": F.col("best.rule"), "action": F.col("best.action")}).drop(
            "best", *[f"{c}{k}" for k in range(1, most + 1) for c in ("domain", "fits")])
    parents = F.transform(F.sequence(F.lit(1), F.least(F.size(F.split("host", r"\.")), F.lit(most))),
                          lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))
    hosts = urls.select("host").where("host != ''").distinct().withColumn("domain", F.explode(parents))
    known = hosts.join(own, "domain").groupBy("host").agg(F.flatten(F.collect_list("fits")).alias("fits"))
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    urls = urls.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
    return urls.join(known, ["host", "salt"], "left").withColumn("best", best("fits")).withColumns(
        {"rule": F.col("best.rule"), "action": F.col("best.action")}).drop("best", "fits", "salt")


def judge_urls(pages: DataFrame, rules: DataFrame, labelled: DataFrame, id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, score, verdict) for each row of ``pages``.

    The verdict is that of the longest fitting rule (of equally long ones the
    last in text order), else ``block`` where the trees' probability is 0.5 or
    more.  ``labelled`` (url, bad 0 or 1) trains them: all rows up to FIT_ROWS.

    A null url, or one without ``://``, has an empty host and path and is judged
    by the trees; null ids and repeated rows are judged one by one; null labels
    teach nothing.  Without labels of both classes the score is their share.
    """
    spark = pages.sparkSession
    tables = Tables(spark, "urls")
    urls = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    parts = {"host": host_of(F.col("url")), "path": path_of(F.col("url"))}
    urls = match_rules(lexical(urls.withColumns(parts)), rules)
    known = lexical(labelled.select(F.col("url").cast("string").alias("url"), F.col("bad").cast("double").alias("bad"))
                    .where("bad is not null").withColumns(parts))
    known = tables.store(known.drop("path"), "labelled")
    n, bad = known.agg(F.count("*"), F.sum("bad")).first()
    share = (float(bad or 0) + 0.5) / (n + 1)
    suffixes = known.groupBy("suffix").agg(
        ((F.sum("bad") + SMOOTH * share) / (F.count("*") + SMOOTH)).alias("suffix_rate"),
        F.log1p(F.count("*")).alias("suffix_weight"))

    def complete(df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(
            df.join(suffixes, "suffix", "left").fillna({"suffix_rate": share, "suffix_weight": 0.0}))

    if n and 0 < bad < n:
        bound = int(min(1.0, FIT_ROWS / n) * (1 << 20))
        sample = known.where(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < bound)
        sample = tables.store(complete(sample).select("features", "bad"), "sample")
        model = GBTClassifier(labelCol="bad", maxIter=ROUNDS, maxDepth=DEPTH, seed=7).fit(sample)
        scored = model.transform(complete(urls)).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = urls.withColumn("score", F.lit(share))
    return scored.select("page_id", "host", "path", "rule", "score", F.coalesce(
        "action", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"))
