"""Quality by hierarchical empirical Bayes: evidence of the text, posteriors of its host and path."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import BYTE, byte_set, hash_words
from .shared import Tables, prepare, slices, utf8

#: Labelled rows, at most (in expectation, by a hash of the id), that the document classifier is fitted on.
FIT_ROWS = 100_000
#: A document is kept from this posterior probability of good quality.
KEEP = 0.2
#: Log-odds of one document's evidence, at most.
MOST_EVIDENCE = 12.0

#: Classes of bytes whose shares are features: lower case, upper case, digits, space,
#: line ends, non-ASCII, sentence marks, exclamation marks, bars, other symbols.
_KIND = np.full(256, 9, np.int64)
for _kind, _ranges in enumerate([((97, 122),), ((65, 90),), ((48, 57),), ((32, 32), (9, 9)), ((10, 13),), ((128, 255),),
                                 ((44, 44), (46, 46), (39, 39), (63, 63), (45, 45)), ((33, 33),), ((124, 124),)]):
    _KIND[byte_set(*_ranges)] = _kind
_LINE = byte_set((10, 10))
FEATURES = [f"share{k}" for k in range(10)] + ["size", "word_size", "fresh_words", "fresh_lines"]


def _fresh(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct over all values of each row; 1 for none."""
    out = np.ones(len(first) - 1)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b - a > 1:
            out[i] = len(np.unique(hashes[a:b])) / (b - a)
    return out


def _features(batches):
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        rows = len(offsets) - 1
        out = np.zeros((rows, len(FEATURES)))
        for a, b in slices(offsets):
            part = offsets[a:b + 1]
            text, part = data[part[0]:part[-1]], part - part[0]
            size = np.diff(part)
            which = np.repeat(np.arange(b - a) * 10, size) + _KIND[text]
            out[a:b, :10] = np.bincount(which, minlength=10 * (b - a)).reshape(-1, 10) / np.maximum(size, 1)[:, None]
            words, _, first = hash_words(text, part, byte=BYTE)
            lines, _, line = hash_words(text, part, _LINE, BYTE)
            out[a:b, 10] = np.log1p(size)
            out[a:b, 11] = np.log1p(size / np.maximum(np.diff(first), 1))
            out[a:b, 12], out[a:b, 13] = _fresh(words, first), _fresh(lines, line)
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("doc_id", "host", "path")] + [pa.array(out[:, k]) for k in range(out.shape[1])],
            ["doc_id", "host", "path", *FEATURES])


def _strength(groups: DataFrame, n: str, k: str, share: float) -> float:
    """Pseudo-counts of a Beta prior around ``share``, from the spread of the groups' rates (moments)."""
    total, spread, inner = groups.agg(
        F.sum(n), F.sum(F.col(n) * F.pow(F.col(k) / F.col(n) - F.lit(share), 2)), F.sum(F.lit(1.0))).first()
    if not total or inner < 2:
        return 20.0
    noise = share * (1 - share)
    between = max((spread - inner * noise) / total, 1e-6)
    return min(max(noise / between - 1, 2.0), 1000.0)


def quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id",
            text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(doc_id, host, path, evidence, host_rate, path_rate, probability, keep) for each row of ``docs``.

    The document classifier (logistic regression on the text's form, on all
    labelled rows up to FIT_ROWS) gives evidence: its log-odds less those of its
    training share.  The share of good documents of a host is shrunk to the
    global share, that of a path to its host's, each with the strength that the
    spread of the groups shows; the posterior log-odds are the path's and the
    evidence together.

    A null text is empty; a null host or path is a group of its own; an id
    labelled several times is good if one label says so; null labels and null ids
    teach nothing; rows that repeat an id are judged one by one.  Without labels
    of both classes there is no evidence and the shares decide (0.5 without any).
    """
    spark = docs.sparkSession
    prepare(spark)
    tables = Tables(spark, "quality")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                       F.coalesce(host.cast("string"), F.lit("")).alias("host"),
                       F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    features = tables.store(rows.mapInArrow(
        _features, "doc_id long, host string, path string, " + ", ".join(f"{c} double" for c in FEATURES)), "features")
    marks = labels.select(F.col(f"`{label_id}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")
                          ).where("y is not null and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    known = tables.store(features.join(marks, "doc_id").withColumn("y", (F.col("y") > 0).cast("double")), "labelled")
    n, good = known.agg(F.count("*"), F.sum("y")).first()
    share = (float(good or 0) + 1) / (n + 2)
    gather = VectorAssembler(inputCols=FEATURES, outputCol="form")
    if n and 0 < good < n:
        bound = int(min(1.0, FIT_ROWS / n) * (1 << 20))
        sample = gather.transform(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < bound))
        scale = StandardScaler(inputCol="form", outputCol="scaled", withMean=True).fit(sample)
        model = LogisticRegression(featuresCol="scaled", labelCol="y", regParam=1e-3, maxIter=60).fit(scale.transform(sample))
        p = F.least(F.greatest(vector_to_array("probability")[1], F.lit(1e-9)), F.lit(1 - 1e-9))
        judged = model.transform(scale.transform(gather.transform(features))).withColumn(
            "evidence", F.log(p / (1 - p)) - F.lit(float(np.log(share / (1 - share)))))
    else:
        judged = features.withColumn("evidence", F.lit(0.0))
    judged = judged.withColumn("evidence", F.greatest(F.least("evidence", F.lit(MOST_EVIDENCE)), F.lit(-MOST_EVIDENCE)))

    # shares of good documents, by partial aggregation: path, then host, then all
    paths = tables.store(known.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("k")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"))
    outer, inner = _strength(hosts, "hn", "hk", share), _strength(paths, "n", "k", share)
    hosts = hosts.select("host", ((F.col("hk") + outer * share) / (F.col("hn") + outer)).alias("host_rate"))
    paths = paths.join(hosts, "host").select(
        "host", "path", ((F.col("k") + inner * F.col("host_rate")) / (F.col("n") + inner)).alias("path_rate"))
    prior = F.col("path_rate")
    return judged.select("doc_id", "host", "path", "evidence").join(hosts, "host", "left").join(
        paths, ["host", "path"], "left").withColumn("host_rate", F.coalesce("host_rate", F.lit(share))).withColumn(
        "path_rate", F.coalesce("path_rate", "host_rate")).withColumn(
        "probability", 1 / (1 + F.exp(-F.log(prior / (1 - prior)) - F.col("evidence")))).select(
        "doc_id", "host", "path", "evidence", "host_rate", "path_rate", "probability",
        (F.col("probability") >= KEEP).alias("keep"))
