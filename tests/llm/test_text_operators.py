"""Near duplicates, repeated passages and tokens against brute force."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from smogcast.llm import bpe, suffixes
from smogcast.llm.components import components
from smogcast.llm.minhash import near_duplicates
from smogcast.llm.shared import Tables
from smogcast.llm.suffixes import remove_repeats

WORDS = [f"w{i}" for i in range(400)]


def _texts(seed=1):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 90))) for _ in range(12)]
    out = [None, "", "   \n", "one two", "one two", "A b C d e", "a B c D E", "é" * 60, "x" * 200, "x" * 200]
    for text in base:
        out.append(text)
        for _ in range(4):
            words = text.split()
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            out.append(" ".join(words))
    return out + [base[0] + "\n" + base[1], base[2][:70] + "é" + base[3][:120], base[5]]


def _shingles(text):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", fold) if w]
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_near_duplicates_match_brute_force(spark, docs, clashing):
    texts = _texts()
    sets = [_shingles(t) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: r for r in near_duplicates(clashing(docs(texts))).collect()}
    assert len(got) == len(texts)
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), label[i], label[i] == i)


def test_dense_groups_below_the_threshold_keep_every_link(spark, docs):
    """Many variants of one text, of which few are linked with the smallest."""
    rng = random.Random(5)
    base = [f"t{i}" for i in range(120)]
    texts = []
    for n in range(60):
        words = list(base)
        for i in range(n % 7):
            words[rng.randrange(120)] = f"n{n}x{i}"
        texts.append(" ".join(words))
    sets = [_shingles(t) for t in texts]
    label = list(range(60))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(texts)).collect()}
    assert [got[i] for i in range(60)] == label


def test_near_duplicates_without_rows_or_ids(spark, docs):
    assert near_duplicates(docs([])).count() == 0
    got = near_duplicates(docs([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in got) == [(-1, None, True), (1, 1, True), (2, 1, False)]


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (5, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long"), Tables(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert components(spark.createDataFrame([], "u long, v long"), Tables(spark, "t")).count() == 0


def _cut(texts):
    """Brute force: every 50-byte window by its smallest document."""
    data = [(t or "").encode() for t in texts]
    least = {}
    for i, d in enumerate(data):
        for a in range(len(d) - 49):
            least.setdefault(d[a:a + 50], i)
    out = []
    for i, d in enumerate(data):
        gone = np.zeros(len(d), bool)
        for a in range(len(d) - 49):
            if least[d[a:a + 50]] < i:
                gone[a:a + 50] = True
        edge = np.flatnonzero(np.diff(gone.astype(int), prepend=0, append=0)).reshape(-1, 2).tolist()
        out.append((len(d), int(gone.sum()), edge, bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


def test_remove_repeats_matches_brute_force(spark, docs, clashing):
    texts = _texts(3)
    frame = clashing(docs(texts)).withColumn("n_bytes", F.lit("x")).withColumn("n_removed", F.lit("x"))
    got = {r.doc_id: r for r in remove_repeats(frame).collect()}          # results replace columns of their names
    for i, (n, removed, spans, kept) in enumerate(_cut(texts)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].spans, bytes(got[i].kept)) == (n, removed, spans, kept), i
        assert got[i].text == texts[i] and got[i].target == 1
    own = remove_repeats(frame, prefix="cut_").collect()                  # or are told apart
    assert all((r.n_bytes, r.kept, r.cut_n_bytes, bytes(r.cut_kept)) == ("x", 1, got[r.doc_id].n_bytes, bytes(got[r.doc_id].kept)) for r in own)


def test_a_passage_with_many_surroundings_is_dealt_to_many_tasks(spark, docs, monkeypatch):
    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = some(70)
    texts = [some(rng.randrange(90)) + passage + some(rng.randrange(90)) for _ in range(2000)]
    stored, store = {}, Tables.store
    monkeypatch.setattr(Tables, "store", lambda self, df, name: stored.setdefault(name, store(self, df, name)))
    for name in ("BUCKET_BYTES", "WINDOWS_BYTES", "GROUP_BYTES"):
        monkeypatch.setattr(suffixes, name, 1 << 15)
    got = {r.doc_id: r for r in remove_repeats(docs(texts)).collect()}
    for i, (n, removed, spans, kept) in enumerate(_cut(texts)):
        assert (got[i].n_removed, got[i].spans, bytes(got[i].kept)) == (removed, spans, kept), i
    for name, kind in (("found", suffixes._SPLIT), ("runs", suffixes._RUNS)):
        n = [r.n for r in stored[name].where(F.col("kind") == kind).groupBy(F.input_file_name()).agg(
            F.sum(F.octet_length("a") / 6).alias("n")).collect()]
        assert max(n) < 0.3 * sum(n), (name, n)


def test_remove_repeats_of_long_texts_across_passes(spark, docs):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(700_000))
    texts = [long, long[333_333:333_700] + "tail", "ab" * 4000, "ab" * 30]
    got = {r.doc_id: r for r in remove_repeats(docs(texts)).collect()}
    for i, (n, removed, spans, kept) in enumerate(_cut(texts)):
        assert (got[i].n_removed, got[i].spans, bytes(got[i].kept)) == (removed, spans, kept)


def test_remove_repeats_keeps_characters_whole(spark, docs):
    shared = "éàü" * 20
    texts = [shared + "a", "bé" + shared + "c", None]
    for r in remove_repeats(docs(texts), characters=True).collect():
        assert bytes(r.kept).decode() is not None
        assert r.n_bytes - r.n_removed == len(r.kept)


def test_remove_repeats_of_odd_ids(spark, docs):
    assert remove_repeats(docs([])).count() == 0
    same = "p" * 40 + "q" * 40
    got = remove_repeats(docs([(None, same), (4, same), (4, same), (9, same)])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (4, 0), (4, 0), (9, 80)]


@pytest.fixture(scope="module")
def encoding():
    return bpe._encoding(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)


def test_bpe_round_trip(spark, docs, encoding):
    texts = [None, "", " ", "<|endoftext|> don't", "naïve 日本 🙂\x00\x1c x", "a" * 70_000, *_texts()[10:20]]
    got = {r.doc_id: r for r in bpe.encode_decode(
        docs(texts), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(texts):
        want = encoding.encode_ordinary(text or "")
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want and got[i].n_tokens == len(want)
        assert bytes(got[i].decoded) == (text or "").encode()


def test_bpe_splits_long_texts_where_it_is_safe(encoding, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(bpe, "LONG_TEXT", 60)
    monkeypatch.setattr(bpe, "LONG_SPACE", 6)
    monkeypatch.setattr(bpe, "_LONG_RUN", re.compile(f"[{bpe._WHITE}]{{6,}}"))
    for _ in range(300):
        text = "".join(rng.choice(["a", "Zé", " ", "  ", "\n", "\x1c", "\xa0", "'s", "12", "!", "日", "      ", "\t\n \n  \n"])
                       for _ in range(rng.randint(1, 150)))
        assert "".join(x for x, _ in bpe.split(text)) == text
        assert bpe.encode(text, encoding) == encoding.encode_ordinary(text)


def test_bpe_of_a_run_of_spaces_that_tiktoken_refuses(encoding):
    text = "a" + " " * 1_500_000 + "b"
    assert encoding.decode(bpe.encode(text, encoding)) == text
