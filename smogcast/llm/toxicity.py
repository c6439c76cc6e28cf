"""Toxicity by class-conditional Kneser-Ney models with shared backoff counts, of words and of characters.

The word models count every word of all labelled rows, in any script; their tables
stay in Spark, grow with the corpus and meet the documents in a join.  The
character models (30 symbols, order 4) judge compounds seen once by sequences that
they share: tables of 30^4 cells, a proven bound for what the driver broadcasts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import byte_set, hash_words
from .shared import Tables, id_and_text, prepare, slices, utf8

ORDER, SYMBOLS = 4, 30
CELLS = SYMBOLS ** ORDER
DISCOUNT = 0.75
#: Symbols of the window whose length-normalised log-ratio is a document's peak.
WINDOW = 16
THRESHOLD = 0.7
EVIDENCE = ["mean", "peak", "expression"]
#: A word is an expression of toxicity from this log-ratio of its probabilities (e^2: seven times likelier).
EXPRESSION = 2.0
#: Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z read as a-z.
_GAP = byte_set((0, 47), (58, 64), (91, 96), (123, 127))

_SPACE = 26
_SYMBOL = np.full(256, 29, np.int32)     # other ASCII
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(26)
_SYMBOL[[32, 9, 10, 13]] = _SPACE
_SYMBOL[48:58] = 27
_SYMBOL[128:] = 28


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each symbol with its history, rows one after the other, and the rows' offsets.

    Each row is read after ``ORDER - 1`` spaces and ends with one.
    """
    rows, lengths = len(offsets) - 1, np.diff(offsets)
    line = np.full(len(data) + ORDER * rows, _SPACE, np.int32)
    line[np.arange(len(data)) + np.repeat(np.arange(rows) * ORDER + ORDER - 1, lengths)] = _SYMBOL[data]
    cells = np.zeros(len(line) - ORDER + 1, np.int32) if len(line) else np.zeros(0, np.int32)
    for k in range(ORDER):
        cells *= SYMBOLS
        cells += line[k:k + len(cells)]
    ends = offsets + ORDER * np.arange(rows + 1)
    own = np.ones(len(cells), bool)
    for k in range(ORDER - 1):          # histories that begin in the row before
        own[ends[1:-1] - 1 - k] = False
    return cells[own], offsets + np.arange(rows + 1)


def _counts(batches):
    """For each class and training part, how often each cell occurs: one row a cell and task."""
    found = np.zeros((4, CELLS), np.int64)
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        for a, b in slices(offsets):
            part = offsets[a:b + 1]
            cells, ends = grams(data[part[0]:part[-1]], part - part[0])
            which = np.repeat(kind[a:b], np.diff(ends))
            found += np.bincount(which * CELLS + cells, minlength=4 * CELLS).reshape(4, CELLS)
    cell = np.flatnonzero(found.any(axis=0))
    for at in range(0, len(cell), 1 << 16):
        part = cell[at:at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part)] + [pa.array(found[k][part]) for k in range(4)],
                                         ["cell", "n0", "n1", "n2", "n3"])


def _row_words(batch):
    """(first row, word hashes, row of each word) for slices of a batch's texts."""
    data, offsets = utf8(batch.column("text"))
    for a, b in slices(offsets):
        part = offsets[a:b + 1]
        words, _, first = hash_words(data[part[0]:part[-1]], part - part[0], _GAP)
        yield words, a + np.repeat(np.arange(b - a), np.diff(first))


def _word_counts(batches):
    """For each class and training part, in how many rows each word occurs: sums by batch."""
    for batch in batches:
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        for words, row in _row_words(batch):
            known, at = np.unique(words, return_inverse=True)
            pair = np.unique(at * len(kind) + row)
            n = np.bincount(pair // len(kind) * 4 + kind[pair % len(kind)], minlength=4 * len(known)).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64))] + [pa.array(x) for x in n.T.astype(np.int64)],
                                             ["word", "n0", "n1", "n2", "n3"])


def _distinct_words(batches):
    """Each row's distinct words, with what tells the row."""
    for batch in batches:
        for words, row in _row_words(batch):
            order = np.lexsort((words, row))
            words, row = words[order], row[order]
            new = np.ones(len(words), bool)
            new[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
            row = pa.array(row[new])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(row) for c in ("doc_id", "fold", "content")] + [pa.array(words[new].view(np.int64))],
                ["doc_id", "fold", "content", "word"])


def expressions(counts: DataFrame) -> DataFrame:
    """(word, ratio, ratio0, ratio2): words that are toxic expressions by all training rows, or by one part's.

    ``counts`` has the ordinary and toxic rows that hold a word in part 0 (n0, n1)
    and part 2 (n2, n3).  p(word | class) is interpolated Kneser-Ney with the class
    as history: the lower order, shared by both, is in how many classes a word
    occurs, not how often.  So a word seen once in one class says little, and one
    that no model has seen, or a model without one of the classes, nothing (0).
    """
    models = {"ratio": (F.col("n0") + F.col("n2"), F.col("n1") + F.col("n3")),
              "ratio0": (F.col("n0"), F.col("n1")), "ratio2": (F.col("n2"), F.col("n3"))}
    totals = counts.agg(*(F.coalesce(F.sum(x), F.lit(0)).cast("double").alias(f"{name}_{k}")
                          for name, (ordinary, toxic) in models.items()
                          for k, x in (("o", ordinary), ("t", toxic),
                                       ("ko", (ordinary > 0).cast("long")), ("kt", (toxic > 0).cast("long"))))).first()

    def share(n, total, kinds, lower):
        return (F.greatest(n - F.lit(DISCOUNT), F.lit(0.0)) + F.lit(DISCOUNT * kinds) * lower) / F.lit(total)

    ratios = []
    for name, (ordinary, toxic) in models.items():
        o, t, ko, kt = (totals[f"{name}_{k}"] for k in ("o", "t", "ko", "kt"))
        if not (o and t):
            ratios.append(F.lit(0.0).alias(name))
            continue
        lower = ((ordinary > 0).cast("double") + (toxic > 0).cast("double")) / F.lit(ko + kt)
        ratio = F.when(lower > 0, F.log(share(toxic, t, kt, lower) / share(ordinary, o, ko, lower))).otherwise(0.0)
        ratios.append(F.when(ratio >= EXPRESSION, ratio).otherwise(0.0).alias(name))
    return counts.select("word", *ratios).where("greatest(ratio, ratio0, ratio2) > 0")


def _smoothed(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Interpolated Kneser-Ney: discounted counts of each history, the rest to ``lower``."""
    table = counts.reshape(-1, SYMBOLS)
    total, kinds = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
    lower = np.resize(lower, table.shape)
    return np.where(total > 0, (np.maximum(table - DISCOUNT, 0) + DISCOUNT * kinds * lower) / np.maximum(total, 1), lower)


def log_ratio(ordinary: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """log p(symbol | history, toxic) - log p(symbol | history, ordinary) of each cell.

    Lower orders are continuation counts of both classes together, so an unseen
    expression backs off to the same probability in both.
    """
    both = ordinary + toxic
    lower = np.full((1, SYMBOLS), 1 / SYMBOLS)
    for n in range(1, ORDER):
        longer = both.reshape(-1, SYMBOLS ** (n + 1)).sum(0).reshape(SYMBOLS, -1)
        lower = _smoothed((longer > 0).sum(0), lower)
    return np.log(_smoothed(toxic, lower) / _smoothed(ordinary, lower)).ravel().astype(np.float32)


def likelihoods(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length-normalised log-ratio of each row, and of its best window.

    A row shorter than a window counts as one window long, so that an empty text
    or a single word says little.
    """
    cells, ends = grams(data, offsets)
    sums = np.concatenate([[0], np.cumsum(table[cells], dtype=np.float64)])
    size = np.diff(ends)
    whole = sums[ends[1:]] - sums[ends[:-1]]
    peak = whole / WINDOW
    long = np.flatnonzero(size >= WINDOW)
    if len(long):
        windows = np.append((sums[WINDOW:] - sums[:-WINDOW]) / WINDOW, -np.inf)
        edges = np.stack([ends[:-1][long], ends[1:][long] - WINDOW + 1], 1).ravel()
        peak[long] = np.maximum.reduceat(windows, edges)[::2]
    return whole / np.maximum(size, WINDOW), peak


def _scored(tables):
    """Mean and peak by the model of all training rows, and by that of the other part (for calibration)."""

    def run(batches):
        full, parts = tables.value[0], tables.value[1:]
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            out = np.zeros((4, len(fold)))
            for a, b in slices(offsets):
                part = offsets[a:b + 1]
                bytes_, part = data[part[0]:part[-1]], part - part[0]
                out[:2, a:b] = likelihoods(bytes_, part, full)
                for own, other in ((0, parts[1]), (2, parts[0])):
                    rows = np.flatnonzero(fold[a:b] == own)
                    if len(rows):
                        found = likelihoods(bytes_, part, other)
                        out[2, a + rows], out[3, a + rows] = found[0][rows], found[1][rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "fold", "content")] + [pa.array(x) for x in out],
                ["doc_id", "fold", "content", "mean", "peak", "cross_mean", "cross_peak"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_id: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(doc_id, held_out, mean, peak, expression, score, predicted) for each row of ``docs``.

    ``mean`` and ``peak`` are length-normalised log-ratios of the character models,
    over the whole text and in its best window; ``expression`` is the log-ratio of
    the text's most toxic word by the word models.  Labels count only for rows
    whose crc32(id as text) mod 3 is not 1.  The two remaining parts score each
    other for the calibration (a logistic regression on the three); the models
    that score are of both parts together.

    An id labelled several times is toxic if one label says so; null labels don't
    count.  A null text is empty and scored as such; a null id is scored, never
    learnt from; rows that repeat an id are scored one by one.  Without labels of
    both classes every score is the share of toxic labels (0 without any).
    """
    spark = docs.sparkSession
    prepare(spark)
    tables = Tables(spark, "toxicity")
    texts = id_and_text(docs, id_col, text_col).withColumn(
        "fold", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(1)).cast("int")).withColumn(
        "content", F.xxhash64("text"))
    marks = labels.select(F.col(f"`{label_id}`").cast("long").alias("doc_id"),
                          F.col(f"`{label_col}`").cast("int").alias("y")).where(
        "y is not null and doc_id is not null and crc32(cast(doc_id as string)) % 3 != 1").groupBy("doc_id").agg(
        F.max("y").alias("y"))
    marks = tables.store(marks, "labels")
    learnt = texts.where("fold != 1").join(marks, "doc_id").select(
        "text", (F.col("fold") + (F.col("y") > 0).cast("int")).alias("kind"))
    counted = learnt.mapInArrow(_counts, "cell long, n0 long, n1 long, n2 long, n3 long").groupBy("cell").agg(
        *(F.sum(f"n{k}").alias(f"n{k}") for k in range(4)))
    found = np.zeros((4, CELLS))
    rows = counted.toArrow()             # at most CELLS rows
    for k in range(4):
        found[k, rows.column("cell").to_numpy()] = rows.column(f"n{k}").to_numpy()
    ratios = np.stack([log_ratio(found[0] + found[2], found[1] + found[3]),
                       log_ratio(found[0], found[1]), log_ratio(found[2], found[3])])
    scored = tables.store(texts.mapInArrow(
        _scored(spark.sparkContext.broadcast(ratios)),
        "doc_id long, fold int, content long, mean double, peak double, cross_mean double, cross_peak double"), "scored")

    # the word models: broadcast by Spark only while the list of expressions is below its threshold
    words = tables.store(learnt.mapInArrow(
        _word_counts, "word long, n0 long, n1 long, n2 long, n3 long").groupBy("word").agg(
        *(F.sum(f"n{k}").alias(f"n{k}") for k in range(4))), "words")
    lexicon = tables.store(expressions(words), "expressions")
    said = texts.mapInArrow(_distinct_words, "doc_id long, fold int, content long, word long").join(lexicon, "word")
    said = tables.store(said.groupBy("doc_id", "content").agg(
        F.max("ratio").alias("expression"),
        F.max(F.when(F.col("fold") == 0, F.col("ratio2")).otherwise(F.col("ratio0"))).alias("cross_expression")), "said")
    said = said.select(F.col("doc_id").alias("__id"), F.col("content").alias("__content"), "expression", "cross_expression")
    scored = scored.join(said, scored["doc_id"].eqNullSafe(said["__id"]) & (scored["content"] == said["__content"]),
                         "left").drop("__id", "__content").fillna(0.0, ["expression", "cross_expression"])
    scored = tables.store(scored, "judged")
    train = scored.where("fold != 1").join(marks, "doc_id").select(
        *(F.col(f"cross_{c}").alias(c) for c in EVIDENCE), (F.col("y") > 0).cast("double").alias("y"))
    train = tables.store(train, "train")
    n, toxic = train.agg(F.count("*"), F.sum("y")).first()
    gather = VectorAssembler(inputCols=EVIDENCE, outputCol="features")
    if n and 0 < toxic < n:
        model = LogisticRegression(labelCol="y", regParam=1e-4, maxIter=50).fit(gather.transform(train))
        scored = model.transform(gather.transform(scored)).withColumn(
            "score", vector_to_array("probability")[1])
    else:
        scored = scored.withColumn("score", F.lit(float(toxic or 0) / max(n, 1)))
    return scored.select("doc_id", (F.col("fold") == 1).alias("held_out"), *EVIDENCE, "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
