"""Near-duplicate groups: MinHash bands propose links, whole shingle sets confirm them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import U64, hash_words, mix, odd, set_key, shingles
from .shared import Tables, id_and_text, slices, prepare, utf8

WORDS = 5
#: 50 bands of 4 minima: a pair at a similarity of 0.75 is missed with a chance of
#: (1 - 0.75^4)^50 = 6e-9, one at 0.8 with 4e-12.
BANDS, ROWS = 50, 4
#: Classes, and shingles, of one block that is compared with another in one task.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 300_000

_HASH = odd(BANDS * ROWS, 1)
_ROW = odd(ROWS, 2)
_BAND = mix(np.arange(BANDS, dtype=U64) + U64(3 << 20))
_BLOCK = 1024


def minima(values: np.ndarray) -> np.ndarray:
    """The least value of each multiplicative universal hash over a set."""
    least = np.full(len(_HASH), np.iinfo(U64).max, U64)
    for at in range(0, len(values), _BLOCK):
        part = values[at:at + _BLOCK]
        np.minimum(least, (_HASH[:, None] * part[None, :]).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    return mix((mix(least).reshape(BANDS, ROWS) * _ROW).sum(axis=1, dtype=U64) + _BAND).view(np.int64)


_SIGNATURE = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"


def _sign(batches):
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        n, k1, k2, bands = [], [], [], []
        for a, b in slices(offsets):
            part = offsets[a:b + 1]
            words, _, first = hash_words(data[part[0]:part[-1]], part - part[0])
            for found in shingles(words, first, WORDS):
                n.append(len(found))
                key = set_key(found)
                k1.append(key[0])
                k2.append(key[1])
                bands.append(band_keys(minima(found)) if len(found) else np.zeros(0, np.int64))
        sizes = np.cumsum([0] + [len(x) for x in bands], dtype=np.int32)
        flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
             pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], ["doc_id", "n_shingles", "k1", "k2", "bands"])


def _sets(batches):
    """Whole shingle sets of representatives; a row whose text isn't the representative's falls away."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        wanted = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist()))
        rows, sets = [], []
        for a, b in slices(offsets):
            part = offsets[a:b + 1]
            words, _, first = hash_words(data[part[0]:part[-1]], part - part[0])
            for i, found in enumerate(shingles(words, first, WORDS), a):
                if set_key(found) == wanted[i]:
                    rows.append(i)
                    sets.append(found.view(np.int64))
        sizes = np.cumsum([0] + [len(x) for x in sets], dtype=np.int32)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(rows, pa.int64())),
             pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], ["rep", "shingles"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, v), those whose whole sets are similar enough."""
    left = sets.select(F.col("rep").alias("u"), F.col("shingles").alias("su"))
    right = sets.select(F.col("rep").alias("v"), F.col("shingles").alias("sv"))
    shared = F.size(F.array_intersect("su", "sv"))
    return pairs.join(left, "u").join(right, "v").where(
        100 * shared >= percent * (F.size("su") + F.size("sv") - shared)).select("u", "v")


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sets, by blocks of common values."""
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)

    def cells(values, sets):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(common, values), max(len(common) - 1, 0))
        same = common[at] == values if len(common) else np.zeros(len(values), bool)
        order = np.argsort(at[same], kind="stable")
        return row[same][order], at[same][order]

    (ra, ca), (rb, cb) = cells(a, left), cells(b, right)
    for at in range(0, len(common), 4096):
        tables = []
        for rows, columns, n in ((ra, ca, len(left)), (rb, cb, len(right))):
            x, y = np.searchsorted(columns, [at, at + 4096])
            table = np.zeros((n, min(4096, len(common) - at)), np.float32)
            table[rows[x:y], columns[x:y] - at] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out.astype(np.int64)


def _compare(percent: int):
    """Links between the classes of two blocks, as a forest over their components."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sides = [rows[rows["side"] == side] for side in (0, 1)]
        if not len(sides[1]):
            sides[1] = sides[0]                    # a block with itself
        out = []
        if len(sides[0]) and rows["component"].nunique() > 1:
            sets = [list(x["shingles"]) for x in sides]
            shared = _shared(*sets)
            n = [np.array([len(x) for x in s]) for s in sets]
            linked = 100 * shared >= percent * (n[0][:, None] + n[1][None, :] - shared)
            reps = [x["rep"].to_numpy() for x in sides]
            comps = [x["component"].to_numpy() for x in sides]
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for i, j in zip(*np.nonzero(linked & (comps[0][:, None] != comps[1][None, :]))):
                a, b = root(int(comps[0][i])), root(int(comps[1][j]))
                if a != b:
                    parent[a] = b
                    out.append((int(reps[0][i]), int(reps[1][j])))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return run


def _between(bands: DataFrame, joined: DataFrame, sets: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """Links (u, v) between classes that share buckets but not a component.

    Classes connected by such buckets are a pool.  A pool is cut by set size, in
    steps that linked sets are at most one apart, and into blocks; each block is
    compared with itself and those it may be linked with, whole sets with whole
    sets, in one task each.  What goes out is a forest of the links found, so
    neither the pairs of a pool nor its links are ever rows.
    """
    labelled = bands.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    mixed = labelled.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b")
    rest = tables.store(labelled.join(mixed.select("band"), "band", "left_semi"), "mixed")
    pools = tables.store(components(rest.select(F.col("rep").alias("u"), F.col("hub").alias("v")), tables), "pools")
    step = F.floor(F.log(F.col("n_shingles").cast("double")) / np.log(100 / percent) + 1e-9).cast("int")
    members = rest.select("rep", "component", "n_shingles").distinct().join(
        pools.select(F.col("node").alias("rep"), F.col("component").alias("pool")), "rep").withColumn("step", step)
    members = tables.store(members, "members")
    blocks = members.groupBy("pool", "step").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("k"))
    members = members.join(blocks, ["pool", "step"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("k")))
    one = blocks.select("pool", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("block"))
    one = tables.store(one, "blocks")
    other = one.select("pool", F.col("step").alias("step2"), F.col("block").alias("block2"))
    pairs = one.join(other, "pool").where("(step2 = step and block2 >= block) or step2 = step + 1")
    key = ["pool", "step", "block", "step2", "block2"]
    members = members.select("pool", "step", "block", "rep", "component").join(sets, "rep")
    left = members.join(pairs, ["pool", "step", "block"]).select(*key, F.lit(0).alias("side"), "rep", "component", "shingles")
    ends = pairs.where("step2 != step or block2 != block").toDF("pool", "step1", "block1", "step", "block")
    right = members.join(ends, ["pool", "step", "block"]).select(
        "pool", F.col("step1").alias("step"), F.col("block1").alias("block"), F.col("step").alias("step2"),
        F.col("block").alias("block2"), F.lit(1).alias("side"), "rep", "component", "shingles")
    return left.union(right).groupBy(*key).applyInPandas(_compare(percent), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each distinct document id.

    Documents with equal sets fall into one class first, so thousands of copies
    cost one signature.  Each band bucket proposes links from its smallest class
    to its others; confirmed links are joined into components; then classes that
    share a bucket but no component are compared block by block.  So no link
    between different sets is lost, and a bucket never emits its pairs.

    A null or empty text, or one without words, has an empty set and is linked
    with nothing.  Rows that repeat an id count as one document, the one with
    the smallest set key.  Null ids form one row, without links, kept.
    """
    spark = docs.sparkSession
    prepare(spark)
    tables = Tables(spark, "minhash")
    texts = id_and_text(docs, id_col, text_col)
    signed = tables.store(texts.mapInArrow(_sign, _SIGNATURE), "signatures")
    key = ["n_shingles", "k1", "k2"]
    documents = tables.store(
        signed.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("key")).select("doc_id", "key.*"), "documents")
    classes = tables.store(
        documents.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
    owned = signed.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *key]).select(
        F.col("doc_id").alias("rep"), "n_shingles", F.explode("bands").alias("band"))
    hubs = owned.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last")
    bands = tables.store(owned.join(hubs.select(F.col("band").alias("band"), "hub"), "band").distinct(), "buckets")
    tables.drop("signatures")
    stars = bands.where("rep != hub").select(F.col("rep").alias("u"), F.col("hub").alias("v")).distinct()
    wanted = bands.select("rep").distinct().join(classes, "rep").withColumnRenamed("rep", "doc_id")
    sets = tables.store(texts.join(wanted, "doc_id").mapInArrow(_sets, "rep long, shingles array<long>")
                        .dropDuplicates(["rep"]), "sets")
    links = tables.store(_confirmed(stars, sets, percent), "confirmed")
    joined = tables.store(components(links, tables), "stars")
    late = tables.store(_between(bands, joined, sets, percent, tables), "late")
    merged = tables.store(components(links.union(late), tables), "components")
    tables.drop("sets", "buckets", "mixed", "pools", "members", "blocks", "stars", "confirmed", "late")
    labels = classes.join(merged.withColumnRenamed("node", "rep"), "rep", "left").select(
        *key, F.coalesce("component", "rep").alias("component_id"))
    return documents.join(labels, key, "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
