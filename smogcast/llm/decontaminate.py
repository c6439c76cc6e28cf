"""Benchmark decontamination: rare seeds by a bound that loses no copy, then Smith-Waterman alignment of words.

An alignment that passes matches at least ceil(similarity * n) of an item's n words.
So however an item is edited, any choice of n - ceil(similarity * n) + h of its words
holds at least h matched ones, and they lie no further apart than such an alignment
can be long.  The seeds of an item are its rarest words, so many that h is an eighth
of the item: documents are joined to items by them, and a stretch with fewer than h
seeds of an item cannot hold a copy.  How often words occur only decides which are
seeds, never what is found.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import BYTE, U64, byte_set, hash_words, mix
from .shared import Tables, id_and_text, prepare, slices, utf8

#: The alignment score by the item's words from which a passage counts as a copy; items of
#: fewer words than this count only as a whole.
SIMILARITY, WHOLE_BELOW = 0.5, 3
#: One in so many words of an item must be seeds that a passage holds.
HELD = 8
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
#: Bytes of benchmark text that are broadcast at once; more is done in blocks of items.
BLOCK_BYTES = 8 << 20
#: Hits of seeds, and words of passages, that a task looks at together.
HITS, PASSAGE_WORDS = 1 << 20, 1 << 20

#: Words are runs of ASCII letters, digits and non-ASCII bytes of the lower-cased text.
_GAP = byte_set((0, 47), (58, 96), (123, 127))


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of lower-cased texts, their bytes' places, and the first word of each row."""
    data, offsets = utf8(pc.utf8_lower(column.fill_null("")))
    hashes, places, firsts = [], [], [np.zeros(1, np.int64)]
    for a, b in slices(offsets, 1 << 19):
        part = offsets[a:b + 1]
        words, place, first = hash_words(data[part[0]:part[-1]], part - part[0], _GAP, BYTE)
        places.append(place + part[0])
        firsts.append(first[1:] + firsts[-1][-1])
        hashes.append(words)
    return (np.concatenate(hashes) if hashes else np.zeros(0, U64),
            np.concatenate(places) if places else np.zeros(0, np.int64), np.concatenate(firsts))


class Seeds:
    """Items of one block: their words, what a passage needs, and the seeds sorted, with a filter of one bit each."""

    _BITS = 22

    def __init__(self, item: np.ndarray, texts: pa.Array, similarity: float):
        self.item = item
        self.words, _, self.first = words_of(texts)
        self.size = np.diff(self.first)
        #: Least score of a copy, seeds that one holds, and words from its first seed to its last.
        self.score = np.where(self.size < WHOLE_BELOW, self.size, similarity * self.size)
        self.matched = np.ceil(self.score - 1e-9).astype(np.int64)
        self.need = np.maximum(1, np.minimum(-(-self.size // HELD), self.matched))
        # a mismatch or a gap takes half a match: an alignment that passes has at most so many words too many
        self.pad = np.ceil(2 * (self.size - self.score)).astype(np.int64) + 1
        self.owner = np.repeat(np.arange(len(item)), self.size)
        self.own, self.own_count = np.unique(self.word_key(self.owner, self.words), return_counts=True)
        self.vocabulary = np.unique(self.words)

    def choose(self, word: np.ndarray, documents: np.ndarray) -> None:
        """Make the rarest words of each item its seeds; ``documents`` is in how many each ``word`` is (else none)."""
        held = np.zeros(len(self.vocabulary), np.int64)
        held[np.searchsorted(self.vocabulary, word)] = documents
        place = np.arange(len(self.words)) - self.first[:-1][self.owner]
        order = np.lexsort((place, held[np.searchsorted(self.vocabulary, self.words)], self.owner))
        rank = np.arange(len(order)) - self.first[:-1][self.owner[order]]
        order = order[rank < (self.size - self.matched + self.need)[self.owner[order]]]
        order = order[np.lexsort((place[order], self.owner[order], self.words[order]))]
        self.seed, self.seed_item, self.place = self.words[order], self.owner[order], place[order]
        self.distinct = np.unique(self.seed)
        self.low, self.high = (np.searchsorted(self.seed, self.distinct, side) for side in ("left", "right"))
        self.filter = np.zeros(1 << self._BITS, bool)
        self.filter[self.distinct >> U64(64 - self._BITS)] = True

    @staticmethod
    def word_key(item: np.ndarray, words: np.ndarray) -> np.ndarray:
        """What tells a word of an item."""
        return mix(words + mix(item.astype(U64))) if len(words) else words

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words that are seeds, and which of the distinct ones each is."""
        at = np.flatnonzero(self.filter[words >> U64(64 - self._BITS)])
        if not len(at):
            return at, at
        which = np.minimum(np.searchsorted(self.distinct, words[at]), len(self.distinct) - 1)
        same = self.distinct[which] == words[at]
        return at[same], which[same]

    def near(self, row: np.ndarray, item: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Which hits are among as many of their row and item, as near to each other, as a copy holds."""
        pair = row * len(self.item) + item
        _, which, count = np.unique(pair, return_inverse=True, return_counts=True)
        many = np.flatnonzero(count[which] >= self.need[item])
        many = many[np.lexsort((hit[many], pair[many]))]
        last = np.arange(len(many)) + self.need[item[many]] - 1
        first = np.flatnonzero(last < len(many))
        last = last[first]
        ok = (pair[many[first]] == pair[many[last]]) & (
            hit[many[last]] - hit[many[first]] < (self.size + self.pad)[item[many[first]]])
        open_ = np.zeros(len(many) + 1, np.int64)
        np.add.at(open_, first[ok], 1)
        np.add.at(open_, last[ok] + 1, -1)
        return many[np.cumsum(open_[:-1]) > 0]


def _best(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Score of the best local alignment, and where it ends in the passage."""
    row, top, end = np.zeros(len(passage) + 1), 0.0, 0
    gaps = -GAP * np.arange(len(passage) + 1)
    for word in item:
        fresh = np.maximum(row + GAP, 0)
        fresh[1:] = np.maximum(fresh[1:], row[:-1] + np.where(passage == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(fresh + gaps) - gaps
        if row.max() > top:
            top, end = float(row.max()), int(row.argmax())
    return top, end


def align(item: np.ndarray, passage: np.ndarray, least: float = 0.0) -> tuple[float, int, int]:
    """Best local alignment of two word sequences: score, and the passage's words [start, end) in it.

    Where the score is below ``least`` the start is not looked for.
    """
    score, end = _best(item, passage)
    if score < least:
        return score, end, end
    _, back = _best(item[::-1], passage[:end][::-1])
    return score, end - back, end


def _spans(row, item, start, end) -> tuple[np.ndarray, ...]:
    """Passages of a row that overlap and have the same item, as one."""
    order = np.lexsort((start, item, row))
    row, item, start, end = (x[order] for x in (row, item, start, end))
    if not len(row):
        return row, item, start, end
    pair = np.ones(len(row), bool)
    pair[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    # the furthest end so far in the same row and item: pairs are lifted above each other
    lift = (np.cumsum(pair) - 1) * (int(end.max()) + 1)
    furthest = np.maximum.accumulate(end + lift) - lift
    new = pair.copy()
    new[1:] |= start[1:] > furthest[:-1]
    at = np.flatnonzero(new)
    return row[at], item[at], start[at], furthest[np.append(at[1:], len(row)) - 1]


def _hopeful(known: Seeds, words: np.ndarray, item, start, end) -> np.ndarray:
    """Which passages can hold a copy of their item, by upper bounds of the score.

    A passage must hold enough of the item's words, in any order; and some stretch of it
    must gain enough if each word that the item has counts as a match and each other
    as a word put in: no alignment of that stretch scores more.
    """
    out = np.zeros(len(item), bool)
    size = end - start
    turn = np.cumsum(size) // PASSAGE_WORDS
    for a, b in zip(*(np.searchsorted(turn, np.unique(turn), side) for side in ("left", "right"))):
        n = size[a:b]
        span = np.repeat(np.arange(b - a), n)
        first = np.cumsum(n) - n
        place = np.repeat(start[a:b] - first, n) + np.arange(len(span))
        key = known.word_key(item[a:b][span], words[place])
        which = np.minimum(np.searchsorted(known.own, key), len(known.own) - 1)
        held = known.own[which] == key
        # the best stretch: a running sum less its least value before, each passage lifted below the last
        step = np.where(held, MATCH, GAP)
        total = np.cumsum(step) - span * (2.0 * len(span) + 2)
        gain = np.maximum.reduceat(total - np.minimum.accumulate(total - step), first)
        good = gain >= known.score[item[a:b]] - 1e-9
        some = held & good[span]
        pair = np.unique(span[some] * len(known.own) + which[some])
        found = np.bincount(pair // len(known.own), known.own_count[pair % len(known.own)], b - a)
        out[a:b] = good & (found >= known.matched[item[a:b]])
    return out


def _frequency(vocabulary):
    """(word, n): in how many of the rows each known word is."""

    def run(batches):
        for batch in batches:
            words, _, first = words_of(batch.column("text"))
            which = np.minimum(np.searchsorted(vocabulary.value, words), max(len(vocabulary.value) - 1, 0))
            known = vocabulary.value[which] == words if len(vocabulary.value) else np.zeros(len(words), bool)
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))[known]
            pair = np.unique(row * len(vocabulary.value) + which[known])
            word, n = np.unique(pair % max(len(vocabulary.value), 1), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(vocabulary.value[word].view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return run


def _copies(seeds):
    """Passages that hold enough seeds of an item, aligned with the item."""

    def run(batches):
        known = seeds.value
        reach = 2 * int((known.size + known.pad).max()) if len(known.size) else 0
        for batch in batches:
            words, _, first = words_of(batch.column("text"))
            at, which = known.hits(words)
            many = (known.high - known.low)[which]
            turn = (np.cumsum(many) - many) // HITS
            out = {}
            for t in np.unique(turn):
                # from the first hit of the turn on, past the last one as far as an alignment may reach
                a, b = np.searchsorted(turn, t), np.searchsorted(turn, t, "right")
                b = int(np.searchsorted(at, at[b - 1] + reach, "right"))
                n = many[a:b]
                hit = np.repeat(at[a:b], n)
                entry = np.repeat(known.low[which[a:b]], n) + np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)
                row, item = np.searchsorted(first, hit, "right") - 1, known.seed_item[entry]
                good = known.near(row, item, hit)
                row, item, hit, place = row[good], item[good], hit[good], known.place[entry[good]]
                start = np.maximum(hit - place - known.pad[item], first[row])
                end = np.minimum(hit - place + known.size[item] + known.pad[item], first[row + 1])
                spans = _spans(row, item, start, end)
                good = _hopeful(known, words, *spans[1:])
                for r, i, x0, x1 in zip(*(x[good].tolist() for x in spans)):
                    own = known.words[known.first[i]:known.first[i + 1]]
                    score, x, y = align(own, words[x0:x1], known.score[i])
                    if score >= known.score[i] - 1e-9 and score / len(own) > out.get((r, i), (0,))[0]:
                        out[r, i] = (score / len(own), x0 + x - int(first[r]), x0 + y - int(first[r]))
            rows = pa.array([r for r, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), pa.array([known.item[i] for _, i in out], pa.int64())]
                + [pa.array([v[k] for v in out.values()], t) for k, t in enumerate((pa.float64(), pa.int64(), pa.int64()))],
                ["doc_id", "item_id", "score", "first_word", "end_word"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) for each document that holds a copy of a test item.

    The seeds of an item are its rarest words, by the number of documents that have
    them, so many that every copy holds some of them (see above), whatever words were
    changed, left out or put in.  Stretches that hold enough seeds are aligned with
    their item unless they hold too few of its words; the score is that of the best
    alignment over the item's number of words (1: a whole copy).  A document has one
    row for an item, its best passage.  The rows are those of aligning every item
    with every document.

    Null or empty texts hold nothing and leak nothing; rows that repeat an id are
    looked at one by one; null ids are carried.  Items of one or two words count only
    as a whole.  Of a long text a bounded number of seeds is looked at together.
    Columns beside id and text are not read.  No rows or no items, no result.
    Benchmarks beyond a bound are broadcast in blocks of items, each of which
    reads the documents twice.
    """
    spark = docs.sparkSession
    prepare(spark)
    tables = Tables(spark, "decontaminate")
    texts = id_and_text(docs, id_col, text_col)
    items = id_and_text(benchmark, item_id, item_text).where("doc_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, found = math.ceil((size + 1) / BLOCK_BYTES), None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == block).orderBy("doc_id", "text").toArrow()
        seeds = Seeds(part.column("doc_id").to_numpy(), part.column("text").combine_chunks(), similarity)
        # at most a row for each word of the block
        counted = texts.mapInArrow(_frequency(spark.sparkContext.broadcast(seeds.vocabulary)), "word long, n long").groupBy(
            "word").agg(F.sum("n").alias("n")).toArrow()
        seeds.choose(counted.column("word").to_numpy().view(U64), counted.column("n").to_numpy())
        one = tables.store(texts.mapInArrow(
            _copies(spark.sparkContext.broadcast(seeds)),
            "doc_id long, item_id long, score double, first_word long, end_word long"), f"copies{block}")
        found = one if found is None else found.union(one)
    return found
