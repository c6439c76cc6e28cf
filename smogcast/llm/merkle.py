"""A Merkle manifest of a table: leaves of rows, a tree for each group, a proof for each row.

Every level is a fixed-offset ``lag`` or ``lead``: a node of level l lives on the
row of its first leaf, so within a block of 2**LEVELS leaves, ordered by place,
the sibling of a node lies 2**l rows away.  The columns are masked by the
node's slot (first or second child) and by the length of the run, and the rows of
first children hash the parents.  The window of a block never holds more than
2**LEVELS rows, whatever a group's size; the roots of the blocks are the
leaves of the next round, so that a hot group is as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Tables

#: Levels that one round builds; a block has two to the power of it rows.
LEVELS = 9
#: What is changed where the CRC-32 of the id is divisible by this.
TAMPER_EVERY = 7


def field(value: Column) -> Column:
    """``-`` for null, else the number of its UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def numbered(tables: Tables, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place ``at`` (from 0) in their ``grp`` by ``order``, and the group's size ``n``.

    Rows are dealt by ranges of (grp, order), so that a group of any size is split;
    the ranges are written, counted, and each row's number within its range is
    added to the rows of its group in the ranges before.  Rows equal in all of
    ``order`` may change places.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = tables.store(
        rows.withColumn("turn", F.monotonically_increasing_id())
        .repartitionByRange(parts, "grp", *order, "turn").withColumn("part", F.spark_partition_id()), name)
    sizes = dealt.groupBy("grp", "part").agg(F.count("*").alias("size"))
    group = Window.partitionBy("grp")
    sizes = sizes.withColumns({
        "n": F.sum("size").over(group),
        "before": F.sum("size").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
    place = F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order, "turn")) - 1
    return dealt.withColumn("place", place).join(sizes.drop("size"), ["grp", "part"]).withColumn(
        "at", F.col("before") + F.col("place")).drop("part", "turn", "place", "before")


def _round(rows: DataFrame, levels: int) -> DataFrame:
    """Build ``levels`` levels over (grp, at, n, node): adds ``top``, the block's root on its first
    row, and ``path``, the (left, sibling) of each level that a row's ancestors pass."""
    size = 1 << levels
    block = Window.partitionBy("grp", "block").orderBy("slot")
    rows = rows.withColumns({"block": F.shiftright("at", levels), "slot": F.pmod("at", F.lit(size)), "node0": F.col("node")})
    for level in range(levels):
        step, node = 1 << level, F.col(f"node{level}")
        here = F.col("slot") % step == 0                       # rows that hold a node of this level
        second = F.col("slot") % (2 * step) >= step
        left, right = F.lag(node, step).over(block), F.lead(node, step).over(block)
        live = F.col("n") > step                               # more than one node remains
        rows = rows.withColumn(f"side{level}", F.when(here & live, F.struct(
            second.alias("left"), F.when(second, left).otherwise(right).alias("sibling"))))
        rows = rows.withColumn(f"node{level + 1}", F.when(F.col("slot") % (2 * step) == 0, F.when(
            live, digest(node, F.coalesce(F.col(f"side{level}.sibling"), F.lit("")))).otherwise(node)))
    # the nearest row at or before a leaf that holds a node of a level holds the leaf's ancestor
    up_to = block.rowsBetween(Window.unboundedPreceding, 0)
    path = F.array(*[F.last(f"side{level}", ignorenulls=True).over(up_to) for level in range(levels)])
    return rows.withColumn("path", F.filter(path, lambda x: x.isNotNull())).withColumn(
        "top", F.col(f"node{levels}")).drop(
        *[f"node{k}" for k in range(levels + 1)], *[f"side{k}" for k in range(levels)])


def tree(tables: Tables, leaves: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The binary trees over (grp, at, n, node): ``leaves`` with their whole ``path``, and (grp, root).

    A run's last node may be alone; its parent is the digest of it alone.  A
    group with a single leaf has that leaf as its root and an empty path.
    """
    most = leaves.agg(F.max("n")).first()[0] or 1
    need = (most - 1).bit_length()
    rounds, rows = [], leaves
    while need or not rounds:
        levels = min(LEVELS, need)
        if levels:
            done = tables.store(_round(rows, levels), f"{name}{len(rounds)}")
        else:
            empty = F.filter(F.array(F.struct(F.lit(True).alias("left"), F.col("node").alias("sibling"))), lambda x: F.lit(False))
            done = rows.withColumns({"block": F.col("at"), "slot": F.lit(0).cast("long"), "path": empty, "top": F.col("node")})
        rounds.append(done)
        rows = done.where("slot = 0").select("grp", F.col("block").alias("at"),
                                             F.ceil(F.col("n") / (1 << levels)).alias("n"), F.col("top").alias("node"))
        need -= levels
    roots = rows.select("grp", F.col("node").alias("root"))
    above = None
    for done in reversed(rounds):
        if above is not None:
            done = done.join(above, ["grp", "block"]).withColumn("path", F.concat("path", "above")).drop("above")
        above = done.select("grp", F.col("at").alias("block"), F.col("path").alias("above"))
    return done.drop("block", "slot", "top"), roots


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda node, x: F.when(
        x["left"], digest(x["sibling"], node)).otherwise(digest(node, F.coalesce(x["sibling"], F.lit("")))))


def manifest(rows: DataFrame, id_col: str = "doc_id", group_col: str = "lang", number_col: str = "n_chars",
             text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, leaf, subroot, root, path, proof_sha256, folded_root, verified) for each row.

    A leaf is the digest of id, source, group, number and text; a group's leaves
    ascend by id, and the groups' roots by group, null first, lead to the root.
    ``path`` holds (left, sibling) from the leaf up to the root, ``proof_sha256`` the
    digest of its siblings.  ``folded_root`` starts from the leaf with 1 added to
    the number where TAMPER_EVERY divides the unsigned CRC-32 of the decimal id.

    A null id comes first in its group and is never tampered with, nor is a null
    number.  Rows that repeat an id are leaves of their own, in the order of
    their digests.  A null or empty text is told apart in the leaf.  The text is
    read once, row by row; only digests move.  No rows, no result.  Other columns
    of the table are not read, whatever their names.
    """
    tables = Tables(rows.sparkSession, "merkle")
    of = lambda name: F.col(f"`{name}`")
    row_id, number = of(id_col).cast("long"), of(number_col).cast("long")
    tamper = number.isNotNull() & (F.crc32(row_id.cast("string").cast("binary")) % TAMPER_EVERY == 0)
    # one more than the largest long is a number too
    leaf = lambda n: digest(field(row_id), field(of(source_col)), field(of(group_col)), field(n), field(of(text_col)))
    leaves = rows.select(
        row_id.alias("doc_id"), F.coalesce(F.concat(F.lit("="), of(group_col).cast("string")), F.lit("-")).alias("grp"),
        leaf(number).alias("node"), F.when(tamper, leaf(number.cast("decimal(20,0)") + 1)).alias("changed"))
    leaves = numbered(tables, leaves, ["doc_id", "node"], "leaves")
    leaves, subroots = tree(tables, leaves, "level")
    subroots = tables.store(subroots, "subroots").select(
        F.lit(0).alias("grp"), F.col("grp").alias("member"), F.col("root").alias("node"))
    subroots, roots = tree(tables, numbered(tables, subroots, ["member"], "groups"), "group")
    tops = subroots.join(roots, "grp").select(
        F.col("member").alias("grp"), F.col("node").alias("subroot"), "root", F.col("path").alias("above"))
    out = leaves.join(tops, "grp").withColumn("path", F.concat("path", "above"))
    siblings = F.array_join(F.transform("path", lambda x: F.coalesce(x["sibling"], F.lit(""))), "")
    out = out.withColumns({"proof_sha256": F.sha2(siblings.cast("binary"), 256),
                           "folded_root": fold(F.coalesce("changed", "node"), F.col("path"))})
    return out.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", "path", "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))
