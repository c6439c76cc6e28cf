"""Repeated passages between documents, by bucket-pointer refinement over sampled suffixes.

A suffix array over every byte position needs eight bytes and several shuffles
for each byte of text.  Here the suffixes are sampled so that every window of 50
bytes still holds one sampled suffix, chosen by the window's content alone: the
position of its least 16-gram (by hash, the last one if several).  So two equal
windows are always found through their sampled suffix.

1. The initial buckets are the 16-grams of the sampled suffixes.
2. Buckets are refined by the bucket identifiers at later offsets: identifiers of
   32 bytes come from two of 16 bytes, those of 50 bytes from two of 32 bytes,
   and those of the whole stretch that a sampled suffix stands for (all windows
   it was chosen in) from two of 50 bytes.  A suffix whose refined bucket also has
   a smaller document is repeated over its whole stretch.
3. Where a 16-gram bucket splits into several stretches, as at the ends of a
   passage, the bucket is refined again, by the 50-byte identifiers of single
   windows, for one document of each stretch: the smallest one.

A 16-gram that very many stretches share, as boilerplate with other text around
it, is hot: its suffixes are dealt by 16-gram and stretch, and its windows by
their own identifier, after each group of documents has kept its smallest
document of each.  So no task has all suffixes or windows of one 16-gram.  Hot
16-grams are found in a sample; which ones they are decides where rows go,
never what comes out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U64, mix
from .shared import Tables, id_and_text, prepare, slices, utf8

WINDOW, GRAM = 50, 16
REACH = WINDOW - GRAM          # the last place of a 16-gram in a window
#: Bytes of text whose suffixes one task refines, and whose documents one group holds.
BUCKET_BYTES, GROUP_BYTES = 24 << 20, 8 << 20
#: The same where buckets are refined to single windows, which are many more.
WINDOWS_BYTES = 5 << 20
#: Bytes of text that a task combines before it sends anything.
UNIT_BYTES = 16 << 20
#: Bytes of one numpy pass, small enough for the processor's cache.
PASS_BYTES = 1 << 18

#: One document of so many is sampled for hot 16-grams, those that so many of the sample's
#: suffixes have; the threshold grows so that at most HOT_MOST are hot.
HOT_SAMPLE, HOT_LEAST, HOT_MOST = 16, 32, 100_000

#: Windows of one pass; a place in it has 22 bits.
_BLOCK, _PLACE = 1 << 21, U64((1 << 22) - 1)
_A, _B, _C, _D = (U64(x) for x in mix(np.arange(4, dtype=U64) + U64(9 << 20)) | U64(1))


def _identifiers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the 16 and of the 50 bytes from each position."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.empty(n, U64)
    for k in range(8):
        at = eight[k::8]
        at[:] = padded[k:k + 8 * len(at)].view(U64)
    eight = eight[:n - 7]
    sixteen = mix(eight[:-8] * _A + eight[8:] * _B)
    m = n - WINDOW + 1
    double = sixteen[:-16] * _C + sixteen[16:] * _D
    return sixteen, mix(double[:m] * _A + double[18:18 + m] * _B)


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Least value of each run of ``size`` values, by doubling."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def sampled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """The sampled suffixes of texts, in order.

    Returns the row of each, its first and its last window (starting bytes in the
    row) and the identifiers of its 16-gram and of its stretch; then the
    identifiers of the 50 bytes from each position of ``data``.
    """
    none = np.zeros(0, np.int64)
    found, identifiers = [], []
    rows, lengths = np.arange(len(offsets) - 1), np.diff(offsets)
    for at in range(0, len(data) - WINDOW + 1, _BLOCK):
        block = data[at:at + _BLOCK + WINDOW - 1]
        sixteen, fifty = _identifiers(block)
        m = len(fifty)
        keys = (sixteen & ~_PLACE) | (_PLACE - np.arange(len(sixteen), dtype=U64))
        place = (_PLACE - (_least(keys, REACH + 1)[:m] & _PLACE)).astype(np.int64)
        row = np.repeat(rows, lengths)[at:at + m] if len(rows) > 1 else np.zeros(m, np.int64)
        whole = np.flatnonzero(np.arange(at + WINDOW, at + WINDOW + m) <= offsets[row + 1])
        identifiers.append(fifty)
        if not len(whole):
            continue
        new = np.ones(len(whole), bool)
        new[1:] = (np.diff(place[whole]) != 0) | (np.diff(row[whole]) != 0)
        first = whole[new]
        last = whole[np.append(np.flatnonzero(new)[1:], len(whole)) - 1]
        place, row = place[first], row[first]
        shape = ((place - first) * 64 + (last - first)).astype(U64)
        stretch = mix(mix(fifty[first] * _C + fifty[last] * _D) + shape * _A)
        found.append((row, first + at - offsets[row], last + at - offsets[row], sixteen[place], stretch))
    if not found:
        return none, none, none, none.view(U64), none.view(U64), none.view(U64)
    return *(np.concatenate(x) for x in zip(*found)), np.concatenate(identifiers)


# --- rows of the shuffles: packed arrays, a few rows for each task and target

_SHORT = U64(16)   # identifiers travel as their upper 48 bits


def _pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view(U64).ravel()


def _group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    return (mix(doc.view(U64)) % U64(groups)).astype(np.int32)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Whether each row starts a run of equal values in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def _dealt(target: np.ndarray, kind: int, doc: np.ndarray, **columns: np.ndarray):
    """One packed row for each target: its documents, how often each follows, and 48-bit columns."""
    order = np.lexsort((doc, target))
    target, doc = target[order], doc[order]
    cut = np.append(np.flatnonzero(_runs(target)), len(target))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        starts = np.flatnonzero(_runs(doc[a:b]))
        yield {"target": int(target[a]), "kind": kind, "docs": doc[a:b][starts].tobytes(),
               "counts": np.diff(starts, append=b - a).astype(np.uint32).tobytes()} | {
               k: _pack48(x[order[a:b]]) if x.dtype == U64 else x[order[a:b]].tobytes() for k, x in columns.items()}


def _docs(row: dict) -> np.ndarray:
    return np.repeat(np.frombuffer(row["docs"], np.int64), np.frombuffer(row["counts"], np.uint32))


_DEALT = pa.schema([("target", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()),
                    ("a", pa.binary()), ("b", pa.binary())])
_DEALT_SQL = "target int, kind int, docs binary, counts binary, a binary, b binary"
_BUCKET, _WHOLE, _SPLIT, _RUNS = range(4)


def _rows(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(list(rows), schema=_DEALT)


def _grams(batches):
    """How many documents of the task have each 16-gram of a sampled suffix."""
    parts = []
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for x, y in slices(offsets, PASS_BYTES):
            part = offsets[x:y + 1]
            row, _, _, gram, _, _ = sampled(data[part[0]:part[-1]], part - part[0])
            order = np.lexsort((gram, row))
            parts.append((gram[order] >> _SHORT)[_runs(gram[order], row[order])])
    gram, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, U64), return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], ["gram", "n"])


def hot_grams(texts: DataFrame) -> np.ndarray:
    """Sorted 16-grams (48 bits) that many documents have, by a sample of the documents."""
    part = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SAMPLE)) == 0)
    counts = part.mapInArrow(_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(
        F.col("n") >= HOT_LEAST)
    most = counts.orderBy(F.col("n").desc(), "gram").limit(HOT_MOST).toArrow()
    return np.sort(most.column("gram").to_numpy().astype(np.int64)).view(U64)


def _mixed_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a) + b) if len(a) else a


def _is_hot(gram: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(gram), bool)
    return hot[np.minimum(np.searchsorted(hot, gram), len(hot) - 1)] == gram


def _suffixes(buckets: int, groups: int, hot):
    """Sampled suffixes by 16-gram, those of hot ones also by stretch.

    Of equal stretches in one unit only the smallest document's goes on.
    """

    def flush(parts):
        doc, gram, stretch = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((doc, stretch, gram))
        doc, gram, stretch = doc[order], gram[order], stretch[order]
        new = _runs(gram, stretch)
        least = doc[new][np.cumsum(new) - 1]
        later = (doc > least) & _runs(gram, stretch, doc)
        yield from _dealt(_group_of(doc[later], groups), _WHOLE, doc[later], a=stretch[later])
        gram, stretch, doc = gram[new], stretch[new], doc[new]
        place = np.where(_is_hot(gram, hot.value), _mixed_key(gram, stretch), gram)
        yield from _dealt((place % U64(buckets)).astype(np.int32), _BUCKET, doc, a=gram, b=stretch)

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column("text"))
            for x, y in slices(offsets, PASS_BYTES):
                part = offsets[x:y + 1]
                row, _, _, gram, stretch, _ = sampled(data[part[0]:part[-1]], part - part[0])
                parts.append((ids[x:y][row], gram >> _SHORT, stretch >> _SHORT))
            size += len(data)
            if size >= UNIT_BYTES:
                yield _rows(flush(parts))
                parts, size = [], 0
        if parts:
            yield _rows(flush(parts))

    return run


def _read(batches, kinds: tuple) -> list[dict]:
    return [row for batch in batches for row in batch.to_pylist() if row["kind"] in kinds]


def _refine(groups: int, hot):
    """Buckets refined to stretches: which are repeated as a whole, which need their single windows."""

    def run(batches):
        rows = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == _BUCKET:
                    rows.append(row)
                else:
                    yield _rows([row])
        if not rows:
            return
        doc = np.concatenate([_docs(r) for r in rows])
        gram = np.concatenate([_unpack48(r["a"]) for r in rows])
        stretch = np.concatenate([_unpack48(r["b"]) for r in rows])
        del rows
        order = np.lexsort((doc, stretch, gram))
        doc, gram, stretch = doc[order], gram[order], stretch[order]
        new = _runs(gram, stretch)
        later = doc > doc[new][np.cumsum(new) - 1]
        yield _rows(_dealt(_group_of(doc[later], groups), _WHOLE, doc[later], a=stretch[later]))
        doc, gram, stretch = doc[new], gram[new], stretch[new]
        bucket = np.cumsum(_runs(gram)) - 1
        if len(doc):
            starts = np.flatnonzero(_runs(gram))
            mixed = (np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts))[bucket]
            mixed |= _is_hot(gram, hot.value)      # other stretches of a hot 16-gram are in other tasks
            yield _rows(_dealt(_group_of(doc[mixed], groups), _SPLIT, doc[mixed], a=stretch[mixed]))

    return run


# --- documents by group, with what was found for them

def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _packed(groups: int):
    """Rows of documents by group, as compressed Arrow streams."""

    def flush(batches):
        table = pa.Table.from_batches(batches)
        group = _group_of(table.column("doc_id").to_numpy(), groups)
        order = np.argsort(group, kind="stable")
        cut = np.append(np.flatnonzero(_runs(group[order])), len(group))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            part = _ipc(table.take(pa.array(order[a:b])).combine_chunks())
            yield pa.RecordBatch.from_pydict({"target": pa.array([group[order[a]]], pa.int32()),
                                              "rows": pa.array([part], pa.binary())})

    def run(batches):
        kept, size = [], 0
        for batch in batches:
            if batch.num_rows:
                kept.append(batch)
                size += batch.nbytes
            if size >= UNIT_BYTES:
                yield from flush(kept)
                kept, size = [], 0
        if kept:
            yield from flush(kept)

    return run


def _unpack(rows: pd.DataFrame) -> pa.Table | None:
    parts = [pa.ipc.open_stream(x).read_all() for x in rows["rows"]]
    return pa.concat_tables(parts) if parts else None


class _Found:
    """Stretches found for the documents of a group, looked up by document and stretch."""

    def __init__(self, rows: list[dict]):
        doc = np.concatenate([np.zeros(0, np.int64)] + [_docs(r) for r in rows])
        stretch = np.concatenate([np.zeros(0, U64)] + [_unpack48(r["a"]) for r in rows])
        spans = [np.frombuffer(r["b"], np.uint16) if r["b"] else np.zeros(len(r["a"]) // 6, np.uint16) for r in rows]
        order = np.lexsort((stretch, doc))
        self.doc, self.stretch = doc[order], stretch[order]
        self.span = np.concatenate([np.zeros(0, np.uint16)] + spans)[order]
        self.key = self._mixed(self.doc, self.stretch)
        again = np.argsort(self.key, kind="stable")
        self.doc, self.stretch, self.span, self.key = (x[again] for x in (self.doc, self.stretch, self.span, self.key))

    @staticmethod
    def _mixed(doc, stretch):
        return mix(mix(doc.view(U64)) + stretch)

    def pairs(self, doc: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each given stretch, once for each entry it has, and that entry."""
        key = self._mixed(doc, stretch)
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        n = high - low
        given = np.repeat(np.arange(len(key)), n)
        entry = np.repeat(low, n) + np.arange(len(given)) - np.repeat(np.cumsum(n) - n, n)
        same = (self.doc[entry] == doc[given]) & (self.stretch[entry] == stretch[given])
        return given[same], entry[same]


def _spans_of(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of adjacent windows: the owner of each, and its first and last place in one number (never 0)."""
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    new = np.ones(len(owner), bool)
    new[1:] = (np.diff(owner) != 0) | (np.diff(place) != 1)
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(owner)) - 1 if len(start) else start
    return owner[start], (place[start] * 256 + place[stop] + 1).astype(np.uint16)


def _each_window(data: np.ndarray, doc, stretch, start, size):
    """Windows of stretches of one group of documents.

    Returns the stretches with the windows that a smaller document of the group has
    (doc, stretch, span), and the windows of the group's smallest document of each
    identifier, which the other groups' must be compared with (doc, stretch, place,
    identifier).
    """
    parts, n = [], size - WINDOW + 1
    for a, b in slices(np.concatenate([[0], np.cumsum(size)])):
        offsets = np.concatenate([[0], np.cumsum(size[a:b])])
        part = np.repeat(start[a:b] - offsets[:-1], size[a:b]) + np.arange(offsets[-1])
        fifty = _identifiers(data[part])[1]
        owner = np.repeat(np.arange(a, b), n[a:b])
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
        parts.append((owner, place, fifty[offsets[owner - a] + place]))
    owner, place, fifty = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((doc[owner], fifty))
    owner, place, fifty = owner[order], place[order], fifty[order]
    new = _runs(fifty)
    later = doc[owner] > doc[owner][new][np.cumsum(new) - 1]
    own, span = _spans_of(owner[later], place[later])
    owner, place, fifty = owner[~later], place[~later], fifty[~later]
    return (doc[own], stretch[own], span), (doc[owner], stretch[owner], place.astype(np.uint8), fifty)


_TEXT, _SINGLE = range(2)


def _contexts(buckets: int, hot):
    """The bytes of stretches whose bucket was split, dealt by their 16-gram again.

    Of hot 16-grams the windows instead, dealt by their identifier, and what the
    group's own documents tell about them.
    """

    def singles(data, doc, stretch, start, size):
        (own, of, span), (doc, stretch, place, fifty) = _each_window(data, doc, stretch, start, size)
        if len(own):
            made = pa.table({"doc": own, "stretch": of, "span": span})
            yield int(own[0] % buckets), _RUNS, _ipc(made), b"", 0       # any task hands them on
        target = (fifty % U64(buckets)).astype(np.int32)
        order = np.argsort(target, kind="stable")
        cut = np.append(np.flatnonzero(_runs(target[order])), len(order))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            pick = order[a:b]
            made = b"".join(x[pick].tobytes() for x in (doc, stretch, fifty, place))
            yield int(target[pick[0]]), _SINGLE, made, b"", b - a

    def run(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        table = _unpack(rows)
        if table is not None and len(found):
            wanted = _Found(found.to_dict("records"))
            ids = table.column("doc_id").to_numpy()
            data, offsets = utf8(table.column("text"))
            seen = set()
            for x, y in slices(offsets, PASS_BYTES):
                part = offsets[x:y + 1]
                row, first, last, gram, stretch, _ = sampled(data[part[0]:part[-1]], part - part[0])
                doc, stretch = ids[x:y][row], stretch >> _SHORT
                given, _ = wanted.pairs(doc, stretch)
                given = [i for i in np.unique(given).tolist()
                         if (k := (int(doc[i]), int(stretch[i]))) not in seen and not seen.add(k)]
                start = part[row[given]] + first[given]
                size = last[given] - first[given] + WINDOW
                out.append((doc[given], gram[given] >> _SHORT, stretch[given], start, size))
        out = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
        doc, gram, stretch, start, size = out
        made = []
        lone = _is_hot(gram.view(U64), hot.value)
        if lone.any():
            made.extend(singles(data, *(x[lone] for x in (doc, stretch, start, size))))
            doc, gram, stretch, start, size = (x[~lone] for x in (doc, gram, stretch, start, size))
        if len(doc):
            target = (gram % U64(buckets)).astype(np.int32)
            order = np.argsort(target, kind="stable")
            cut = np.append(np.flatnonzero(_runs(target[order])), len(order))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                pick = order[a:b]
                text = b"".join(data[i:i + n].tobytes() for i, n in zip(start[pick].tolist(), size[pick].tolist()))
                table = pa.table({"doc": doc[pick], "gram": gram[pick], "stretch": stretch[pick],
                                  "size": size[pick].astype(np.uint8)})
                made.append((int(target[order[a]]), _TEXT, _ipc(table), pa.compress(text, "zstd", asbytes=True), len(text)))
        return pd.DataFrame(made, columns=["target", "kind", "rows", "text", "n"])

    return run


def _windows(groups: int):
    """Split buckets refined by the 50-byte identifiers of their windows."""

    def texts(rows):
        tables = [pa.ipc.open_stream(row["rows"]).read_all() for row in rows]
        texts = [np.frombuffer(pa.decompress(row["text"], row["n"], "zstd", asbytes=True), np.uint8) for row in rows]
        doc, gram, stretch, size = (np.concatenate([t.column(c).to_numpy() for t in tables])
                                    for c in ("doc", "gram", "stretch", "size"))
        offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        text = np.concatenate(texts)
        fifty = np.zeros(len(text), U64)
        for at in range(0, len(text) - WINDOW + 1, PASS_BYTES):
            part = _identifiers(text[at:at + PASS_BYTES + WINDOW - 1])[1]
            fifty[at:at + len(part)] = part
        n = size.astype(np.int64) - WINDOW + 1
        owner = np.repeat(np.arange(len(doc)), n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        fifty = fifty[offsets[owner] + place]
        order = np.lexsort((doc[owner], fifty, gram[owner]))
        owner, place, fifty = owner[order], place[order], fifty[order]
        new = _runs(gram[owner], fifty)
        later = doc[owner] > doc[owner][new][np.cumsum(new) - 1]
        own, span = _spans_of(owner[later], place[later])
        return doc[own], stretch[own], span

    def singles(rows):
        doc, stretch, fifty, place = (np.concatenate([np.frombuffer(r["rows"], kind, r["n"], at * r["n"]) for r in rows])
                                      for kind, at in ((np.int64, 0), (U64, 8), (U64, 16), (np.uint8, 24)))
        order = np.lexsort((doc, fifty))
        new = _runs(fifty[order])
        later = order[doc[order] > doc[order][new][np.cumsum(new) - 1]]
        doc, stretch, place = doc[later], stretch[later], place[later].astype(np.int64)
        order = np.lexsort((stretch, doc))
        doc, stretch, place = doc[order], stretch[order], place[order]
        own, span = _spans_of(np.cumsum(_runs(doc, stretch)) - 1, place)
        first = np.flatnonzero(_runs(doc, stretch))
        return doc[first][own], stretch[first][own], span

    def run(batches):
        kept = {_TEXT: [], _SINGLE: []}
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == _RUNS:
                    told = pa.ipc.open_stream(row["rows"]).read_all()
                    doc, stretch, span = (told.column(c).to_numpy() for c in ("doc", "stretch", "span"))
                    yield _rows(_dealt(_group_of(doc, groups), _RUNS, doc, a=stretch, b=span))
                else:
                    kept[row["kind"]].append(row)
        for kind, refine in ((_TEXT, texts), (_SINGLE, singles)):
            if kept[kind]:
                doc, stretch, span = refine(kept[kind])
                if len(doc):
                    yield _rows(_dealt(_group_of(doc, groups), _RUNS, doc, a=stretch, b=span))

    return run


def _cut(columns: list[str], characters: bool):
    """Documents of a group without what is repeated."""

    def run(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        table = _unpack(rows)
        if table is None:
            return pd.DataFrame(columns=[*columns, "n_bytes", "n_removed", "spans", "kept"])
        marked = _Found(found.to_dict("records"))
        ids = table.column("doc_id").to_numpy()
        data, offsets = utf8(table.column("text"))
        gone = np.zeros(len(data) + 1, np.int32)
        for x, y in slices(offsets, PASS_BYTES):
            part = offsets[x:y + 1]
            row, first, last, _, stretch, _ = sampled(data[part[0]:part[-1]], part - part[0])
            given, entry = marked.pairs(ids[x:y][row], stretch >> _SHORT)
            span = marked.span[entry].astype(np.int64)
            start = part[row[given]] + first[given]
            whole = span == 0
            to = np.where(whole, part[row[given]] + last[given], start + span % 256 - 1)
            start = np.where(whole, start, start + span // 256)
            np.add.at(gone, start, 1)
            np.add.at(gone, to + WINDOW, -1)
        gone = np.cumsum(gone[:-1]) > 0
        spans, kept, removed = [], [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            edge = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            if characters and len(edge):
                own = data[a:b]
                starts = np.append(np.flatnonzero((own & 0xC0) != 0x80), b - a)
                first = starts[np.searchsorted(starts, edge[:, 0], "left")]
                last = starts[np.searchsorted(starts, edge[:, 1], "right") - 1]
                edge = np.stack([first, last], 1)[first < last]
                gone[a:b] = False
                for x, y in edge.tolist():
                    gone[a + x:a + y] = True
            spans.append(edge.tolist())
            kept.append(data[a:b][~gone[a:b]].tobytes())
            removed.append(b - a - len(kept[-1]))
        out = table.select(columns).to_pandas()
        return out.assign(n_bytes=np.diff(offsets), n_removed=removed, spans=spans, kept=kept)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   characters: bool = False, prefix: str = "") -> DataFrame:
    """Documents without the bytes that a smaller document also has, in runs of 50 bytes or more.

    Every byte covered by a 50-byte string that also starts in a document with a
    smaller id is removed; overlaps count, and strings are judged on the input.
    Returns all columns of ``docs`` (the texts as they were) and n_bytes,
    n_removed, spans (array of [start, end) of the maximal removed runs) and
    kept (binary, the bytes that stay, concatenated).  With ``characters`` a run
    begins and ends between characters, so that what stays is UTF-8 again.  The
    names of the four begin with ``prefix``; columns of ``docs`` that have one of
    these names are replaced.

    Null or empty texts and texts of less than 50 bytes stay as they are.  Rows
    that repeat an id are parts of one document and never remove from each other;
    rows with a null id neither remove nor lose anything.
    """
    spark = docs.sparkSession
    prepare(spark)
    tables = Tables(spark, "suffixes")
    known = docs.where(F.col(f"`{id_col}`").isNotNull())
    texts = id_and_text(known, id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    hot = spark.sparkContext.broadcast(hot_grams(texts))
    buckets, groups = math.ceil((size + 1) / BUCKET_BYTES), math.ceil((size + 1) / GROUP_BYTES)

    found = tables.store(
        texts.mapInArrow(_suffixes(buckets, groups, hot), _DEALT_SQL)
        .repartition(buckets, "target").mapInArrow(_refine(groups, hot), _DEALT_SQL), "found")
    split = found.where(F.col("kind") == _SPLIT)
    packed = texts.mapInArrow(_packed(groups), "target int, rows binary")
    fine = math.ceil((size + 1) / WINDOWS_BYTES)
    contexts = packed.groupBy("target").cogroup(split.groupBy("target")).applyInPandas(
        _contexts(fine, hot), "target int, kind int, rows binary, text binary, n long")
    runs = tables.store(contexts.repartition(fine, "target").mapInArrow(_windows(groups), _DEALT_SQL), "runs")

    results = {n: prefix + n for n in ("n_bytes", "n_removed", "spans", "kept")}
    others = [c for c in docs.columns if c not in (id_col, text_col, *results.values())]
    carried = {c: f"c{i}" for i, c in enumerate(others)}
    rows = known.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                        *(F.col(f"`{c}`").alias(n) for c, n in carried.items()))
    columns = rows.columns
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    result = rows.mapInArrow(_packed(groups), "target int, rows binary").groupBy("target").cogroup(
        found.where(F.col("kind") == _WHOLE).union(runs).groupBy("target")).applyInPandas(
        _cut(columns, characters), f"{schema}, n_bytes long, n_removed long, spans array<array<long>>, kept binary")
    back = {"doc_id": id_col, "text": text_col} | {n: c for c, n in carried.items()}
    result = result.select(*(F.col(n).alias(back[n]) for n in columns), *(F.col(n).alias(r) for n, r in results.items()))
    loose = docs.where(F.col(f"`{id_col}`").isNull()).select(
        *(F.col(f"`{back[n]}`").alias(back[n]) for n in columns),
        F.octet_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("long").alias(results["n_bytes"]),
        F.lit(0).cast("long").alias(results["n_removed"]), F.array().cast("array<array<long>>").alias(results["spans"]),
        F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "utf-8").alias(results["kept"]))
    return result.unionByName(loose)
