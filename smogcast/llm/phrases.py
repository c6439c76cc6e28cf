"""Phrases that occur often, scored as collocations, by Rabin-Karp fingerprints.

The words of a stretch of text are hashed, and a prefix polynomial over the
hashes gives the fingerprint of every n-gram as a difference of two prefixes.
Fingerprints are counted level by level: a phrase occurs no more often than any
part of it, so an n-gram counts only where both of its (n-1)-grams may be
frequent.  That is asked of a bitmap of fixed size, which holds a bit for each
frequent fingerprint: bits that two fingerprints share cost work, never a phrase.

Counts of fingerprints only choose what may be frequent.  The last pass groups the
occurrences by fingerprint, compares each group's words with those of one
occurrence, writes the phrase down and counts by its text, with the place of
its first occurrence; so colliding fingerprints cannot change a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import BYTE_FOLDED, U64, byte_set, hash_words, mix, odd
from .shared import SLICE_BYTES, Tables, prepare, slices, utf8

#: Words of the longest phrase, occurrences of a frequent one, phrases reported for each language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: The bitmap of what may be frequent has two to the power of it bits (8 MB), whatever the corpus.
FILTER_BITS = 26
#: Shares that one language's phrases are dealt in.
SALTS = 64
#: Fingerprints that a task counts before it sends anything.
BUFFER = 1 << 21

#: What parts pieces, and what parts words.
PIECE_END = byte_set((0x0A, 0x0D), *[(ord(c),) * 2 for c in ".,;:!?"])
WORD_END = PIECE_END | byte_set((0x20, 0x20), (0x09, 0x09))

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BASE = int(odd(1, 11)[0])


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, U64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def fingerprints(words: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """For each size, the fingerprint of the n-gram from every word on (mod 2**64)."""
    n = len(words)
    prefix = np.zeros(n + 1, U64)
    np.cumsum(words * _powers(_BASE, n), out=prefix[1:])
    back = _powers(pow(_BASE, -1, 1 << 64), n)
    return [(prefix[k:] - prefix[:max(n + 1 - k, 0)]) * back[:max(n + 1 - k, 0)] for k in sizes]


class _Words:
    """The words of a stretch of text: hash, piece, language, and their bytes joined by single spaces."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, salts: np.ndarray, bits: int):
        self.bits = bits
        self.hashes, self.start, first = hash_words(data, offsets, WORD_END, BYTE_FOLDED)
        if bits < 64:
            self.hashes = self.hashes >> U64(64 - bits)
        self.data, self.row = data, np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        edge = PIECE_END[data].astype(np.int32)
        edge[offsets[:-1][offsets[:-1] < offsets[1:]]] += 1
        self.piece = np.cumsum(edge)[self.start]
        self.lang, self.salt = langs[self.row], salts[langs[self.row]]

    def __len__(self) -> int:
        return len(self.hashes)

    def keys(self, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each size the first words of the n-grams that lie within a piece, and their keys."""
        out = []
        for k, value in zip(sizes, fingerprints(self.hashes, sizes)):
            at = np.flatnonzero(self.piece[k - 1:] == self.piece[:max(len(self) - k + 1, 0)])
            key = mix((value[at] ^ self.salt[at]) + U64(k)) if len(at) else np.zeros(0, U64)
            out.append((at, key >> U64(64 - self.bits) << U64(64 - self.bits) if self.bits < 64 else key))
        return out

    def spell(self) -> None:
        """Number the words by their bytes, and join them: word i is text[begin[i]:end[i]]."""
        inside = ~WORD_END[self.data]
        letters = _FOLD[self.data[inside]]
        at = np.cumsum(inside)[self.start] - 1
        length = np.diff(at, append=len(letters))
        self.begin = at + np.arange(len(at))
        self.end = self.begin + length
        self.text = np.full(len(letters) + len(at), 32, np.uint8)
        self.text[np.arange(len(letters)) + np.repeat(np.arange(len(at)), length)] = letters
        _, one, self.word = np.unique(self.hashes, return_index=True, return_inverse=True)
        same = length == length[one][self.word]
        here, there = (np.repeat(x, length * same) for x in (at, at[one][self.word]))
        step = np.arange(len(here)) - np.repeat(np.cumsum(length * same) - length * same, length * same)
        unlike = letters[here + step] != letters[there + step]
        same[np.repeat(np.arange(len(at)), length * same)[unlike]] = False
        more: dict[bytes, int] = {}
        for i in np.flatnonzero(~same):            # other words with the same hash
            spelt = self.text[self.begin[i]:self.end[i]].tobytes()
            self.word[i] = more.setdefault(spelt, len(one) + len(more))

    def groups(self, k: int, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First occurrence and number of occurrences of each distinct n-gram among ``at``."""
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
        same = self.lang[at] == self.lang[at[one]][which]
        for j in range(k):
            same &= self.word[at + j] == self.word[at[one] + j][which]
        first, count = at[one], np.bincount(which[same], minlength=len(one))
        if not same.all():                         # other n-grams with the same fingerprint
            more: dict[tuple, list[int]] = {}
            for i in at[~same].tolist():
                more.setdefault((int(self.lang[i]), *self.word[i:i + k].tolist()), []).append(i)
            first = np.append(first, [x[0] for x in more.values()]).astype(np.int64)
            count = np.append(count, [len(x) for x in more.values()]).astype(np.int64)
        return first, count

    def phrases(self, k: int, first: np.ndarray) -> pa.Array:
        begin, length = self.begin[first], self.end[first + k - 1] - self.begin[first]
        ends = np.cumsum(length)
        take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - length), length)
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(first), [
            None, pa.py_buffer(offsets), pa.py_buffer(self.text[take])]).cast(pa.string())


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _split_long(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets with long rows cut after ends of pieces, and the row of each part."""
    cuts, rows = [], []
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        parts = [a]
        if b - a > SLICE_BYTES:
            ends = np.flatnonzero(PIECE_END[data[a:b]]) + a + 1
            while b - parts[-1] > SLICE_BYTES and (i := int(np.searchsorted(ends, parts[-1] + SLICE_BYTES))) < len(ends):
                parts.append(int(ends[i]))
        cuts += parts
        rows += [row] * len(parts)
    return np.array([*cuts, int(offsets[-1])], np.int64), np.array(rows, np.int64)


def _stretches(batch: pa.RecordBatch, bits: int) -> Iterator[tuple[_Words, np.ndarray, np.ndarray]]:
    """The words of a batch in stretches of a few MB; for each row of a stretch the batch's row,
    and what to add to a place in the stretch for the place in the row's text."""
    data, offsets = utf8(batch.column("text"))
    starts = offsets[:-1]
    offsets, rows = _split_long(data, offsets)
    names = batch.column("lang").dictionary_encode()
    langs, salts = names.indices.to_numpy(), np.array([_salt(x) for x in names.dictionary.to_pylist()], U64)
    for a, b in slices(offsets):
        part = offsets[a:b + 1]
        yield (_Words(data[part[0]:part[-1]], part - part[0], langs[rows[a:b]], salts, bits), rows[a:b],
               part[0] - starts[rows[a:b]])


def _maybe(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    bit = key >> U64(64 - FILTER_BITS)
    return bitmap[bit >> U64(3)] >> (bit & U64(7)).astype(np.uint8) & np.uint8(1) == 1


def _supported(words: _Words, size: int, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of ``size`` words whose two parts of one word less may both be frequent."""
    (at, key), (longer, keys) = words.keys([size - 1, size])
    may = np.zeros(len(words) + 1, bool)
    may[at] = _maybe(bitmap, key)
    both = may[longer] & may[longer + 1]
    return longer[both], keys[both]


def _counter(bitmap, sizes: list[int], bits: int):
    """Counts (key, n) of the n-grams of ``sizes``; with a bitmap, of the supported ones."""
    def run(batches):
        held, size = [], 0

        def out():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

        for batch in batches:
            for words, _, _ in _stretches(batch, bits):
                for k, key in ([(k, x[1]) for k, x in zip(sizes, words.keys(sizes))] if bitmap is None
                               else [(k, _supported(words, k, bitmap.value)[1]) for k in sizes]):
                    held.append(key)
                    size += len(key)
                if size >= BUFFER:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return run


def _writer(bitmap, longest: int, bits: int):
    """(lang, size, phrase, n, doc_id, start) of what may be frequent; size 0 counts all words."""
    def run(batches):
        for batch in batches:
            langs, ids = batch.column("lang"), batch.column("doc_id")
            for words, rows, starts in _stretches(batch, bits):
                if not len(words):
                    continue
                words.spell()
                found = []
                for k in range(1, longest):
                    at, key = words.keys([k])[0]
                    may = _maybe(bitmap.value, key)
                    found.append((k, at[may], key[may]))
                found.append((longest, *_supported(words, longest, bitmap.value)))
                for k, at, key in found:
                    if not len(at):
                        continue
                    first, n = words.groups(k, at, key)
                    row = words.row[first]
                    yield pa.RecordBatch.from_arrays(
                        [langs.take(pa.array(rows[row])), pa.array(np.full(len(n), k, np.int32)), words.phrases(k, first),
                         pa.array(n.astype(np.int64)), ids.take(pa.array(rows[row])),
                         pa.array(words.start[first] + starts[row])], _WRITTEN)
                total = np.bincount(words.row, minlength=len(rows))
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(rows[some])), pa.array(np.zeros(len(some), np.int32)), pa.array([""] * len(some)),
                     pa.array(total[some]), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64())], _WRITTEN)

    return run


_WRITTEN = ["lang", "size", "phrase", "n", "doc_id", "start"]


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang", bits: int = 64) -> DataFrame:
    """(lang, size, phrase, n, doc_id, start) of the phrases of 1 to ``longest`` words with n >= ``least``.

    ``doc_id`` and ``start`` (in bytes) are the place of one occurrence, in the
    smallest id that has one (null if no id is known).  A row of size 0 for each
    language counts all its words.  ``bits`` is the length of the fingerprints;
    any length gives the same result.
    """
    spark = docs.sparkSession
    prepare(spark)
    tables = Tables(spark, "phrases")
    of = lambda name, kind: F.col(f"`{name}`").cast(kind)
    rows = docs.select(of(id_col, "long").alias("doc_id"), of(text_col, "string").alias("text"),
                       F.coalesce(of(lang_col, "string"), F.lit("und")).alias("lang"))
    bitmap, held = np.zeros(1 << (FILTER_BITS - 3), np.uint8), None
    bit = F.shiftrightunsigned("key", 64 - FILTER_BITS) + 1
    for sizes in [list(range(1, min(longest, 3))), *[[k] for k in range(3, longest)]]:
        counted = rows.mapInArrow(_counter(held, sizes, bits), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        for part in counted.where(F.col("n") >= least).groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(
                F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect():
            at = (part["part"] - 1) * len(part["bits"])
            bitmap[at:at + len(part["bits"])] |= np.frombuffer(part["bits"], np.uint8)[:len(bitmap) - at]
        held = spark.sparkContext.broadcast(bitmap.copy())
    written = rows.mapInArrow(_writer(held, longest, bits), "lang string, size int, phrase string, n long, doc_id long, start long")
    # id and place as one number, which a hash aggregation can keep in its buffer
    pointer = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << _PLACE_BITS).cast("decimal(13,0)") + F.col("start")
    counted = written.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"), F.min(pointer).alias("pointer"))
    doc = F.floor(F.col("pointer") / F.lit(1 << _PLACE_BITS).cast("decimal(13,0)"))
    return tables.store(counted.where((F.col("n") >= least) | (F.col("size") == 0)).select(
        "lang", "size", "phrase", "n", doc.cast("long").alias("doc_id"),
        F.pmod("pointer", F.lit(1 << _PLACE_BITS).cast("decimal(13,0)")).cast("long").alias("start")), "phrases")


#: A place in a text has so many bits beside the id.
_PLACE_BITS = 40


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, id_col: str = "doc_id",
                 text_col: str = "text", lang_col: str = "lang", bits: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, doc_id, start): each language's ``top`` phrases of 2 to ``longest`` words.

    A phrase counts (``a``) all its occurrences within pieces of text, overlapping
    ones too.  Cut after its first k words into parts with ``l`` and ``r``
    occurrences its score is floor(1000 a n / (l r)), n being the language's words;
    the lowest-scoring cut counts, of equal ones the shortest first part.  A phrase
    inside a longer frequent one with as many occurrences is dropped.  Order:
    score and ``a`` descending, phrase ascending by its UTF-8 bytes.

    A null text is empty, a null language ``und``; null and repeated ids and rows
    that repeat count like any others.  Long texts are cut between pieces.  No
    rows, no frequent phrase: no result.  Other columns are not read.
    """
    table = frequent(docs, least, longest, id_col, text_col, lang_col, bits)
    words = F.split("phrase", " ")
    found = table.where("size > 1").withColumnRenamed("n", "a")
    cuts = found.withColumn("k", F.explode(F.expr("sequence(1, size - 1)"))).withColumns({
        "first": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "),
        "rest": F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ")})
    part = table.where("size > 0")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    whole = lambda name: F.col(name).cast("decimal(18,0)")
    # a language may have most phrases: its words are joined in SALTS shares
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    total = table.where("size = 0").select("lang", "n", salts.alias("salt"))
    cuts = cuts.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).join(total, ["lang", "salt"]).withColumns({
        "above": F.lit(1000).cast("decimal(4,0)") * whole("a") * whole("n"), "below": whole("l") * whole("r")})
    best = cuts.withColumn("score", F.expr("above div below")).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r", "a", "n", "doc_id", "start")).alias("cut")).select("lang", "phrase", "cut.*")
    inner = F.flatten(F.transform(F.expr("sequence(2, size - 1)"), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("size") - size + 1), lambda at: F.array_join(F.slice(words, at, size), " "))))
    within = found.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(
        F.max("a").alias("longer"))
    left = best.join(within, ["lang", "phrase"], "left").where("longer is null or longer < a")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return left.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score", "doc_id", "start")
