"""The Merkle manifest against a plain recursion."""

import hashlib
import zlib

from pyspark.sql import functions as F

from smogcast.llm import merkle
from smogcast.llm.merkle import manifest

TABLE = "doc_id long, text string, lang string, source string, n_chars long"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, text, lang, source, n):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def _tree(nodes):
    """Root, and for each leaf the (siblings before, siblings after) of its ancestors."""
    paths, own = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, down = [], []
        for i in range(0, len(nodes), 2):
            run = nodes[i:i + 2]
            for j, leaves in enumerate(own[i:i + 2]):
                for leaf in leaves:
                    paths[leaf].append((run[:j], run[j + 1:]))
            up.append(_h(*run))
            down.append(sum(own[i:i + 2], []))
        nodes, own = up, down
    return nodes[0], paths


def _plain(rows):
    groups, out = {}, []
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(*r)))
    built = [_tree([_leaf(*r) for r in groups[g]]) for g in order]
    root, tops = _tree([b[0] for b in built])
    for g, (sub, paths), top in zip(order, built, tops):
        for row, path in zip(groups[g], paths):
            full = path + top
            doc_id, text, lang, source, n = row
            hit = doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            node = _leaf(doc_id, text, lang, source, n + 1 if hit else n)
            for before, after in full:
                node = _h(*before, node, *after)
            out.append((doc_id, _leaf(*row), sub, root, _h(*(x for b, a in full for x in b + a)), node, node == root))
    return sorted(out, key=str)


def _got(df):
    return sorted(map(tuple, manifest(df).drop("path").collect()), key=str)


def _rows(sizes):
    rows, k = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((k * 3 - 20, f"text {k} é", lang, None if k % 5 == 0 else "s", None if k % 11 == 0 else k))
            k += 1
    return rows


def test_every_size_of_group_equals_the_plain_tree(spark):
    rows = _rows({"en": 33, "de": 16, "fr": 17, "es": 1, None: 2, "": 3, "é": 5, "zz": 4})
    assert _got(spark.createDataFrame(rows, TABLE)) == _plain(rows)


def test_groups_longer_than_a_block_take_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    rows = _rows({"en": 67, "de": 4, "fr": 5, "a": 1, "b": 1, "c": 1, "d": 1})
    assert _got(spark.createDataFrame(rows, TABLE)) == _plain(rows)


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    rows = _rows({"en": 9}) + [(None, None, None, None, None), (None, "", "en", "s", 3), (4, "same", "en", "s", 1),
                               (4, "same", "en", "s", 1), (4, "other", "en", "s", 2 ** 63 - 1), (7, "x" * 3_000_000, "en", "s", 1)]
    df = spark.createDataFrame(rows, TABLE)
    for name in ("grp", "node", "at", "n", "root", "path", "turn", "part", "block", "slot", "leaf", "subroot", "verified"):
        df = df.withColumn(name, F.lit(1))
    assert _got(df) == _plain(rows)


def test_changed_rows_are_found_and_only_they(spark):
    rows = [(k, f"t{k}", "en", "s", 5) for k in range(200)]
    got = manifest(spark.createDataFrame(rows, TABLE)).collect()
    assert {r.doc_id for r in got if not r.verified} == {k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 0}
    assert all(len(r.path) == 8 for r in got)


def test_no_rows(spark):
    assert manifest(spark.createDataFrame([], TABLE)).count() == 0
