"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from smogcast.llm import phrases
from smogcast.llm.phrases import collocations, fingerprints, frequent

TABLE = "doc_id long, text string, lang string"


def _grams(rows, longest=5):
    counts, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, " ".join(words[i:i + k])] += 1
    return counts, total


def _plain(rows, least, top):
    counts, total = _grams(rows)
    found = {key: a for key, a in counts.items() if a >= least and " " in key[1]}
    longer = Counter()
    for (lang, phrase), a in found.items():
        words = phrase.split(" ")
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                key = lang, " ".join(words[i:i + k])
                longer[key] = max(longer[key], a)
    out = {}
    for (lang, phrase), a in found.items():
        if longer[lang, phrase] >= a:
            continue
        words, best = phrase.split(" "), None
        for k in range(1, len(words)):
            l, r = counts[lang, " ".join(words[:k])], counts[lang, " ".join(words[k:])]
            cut = (1000 * a * total[lang] // (l * r), k, l, r)
            best = min(best, cut) if best else cut
        out.setdefault(lang, []).append((-best[0], -a, phrase.encode(), best[2], best[3]))
    return sorted((lang, rank, p.decode(), -a, l, r, total[lang], -score)
                  for lang, all_ in out.items() for rank, (score, a, p, l, r) in enumerate(sorted(all_)[:top], 1))


def _got(df, least=5, top=20, **more):
    return sorted(map(tuple, collocations(df, least, top=top, **more).drop("doc_id", "start").collect()))


def _rows(seed, n=120):
    rng = random.Random(seed)
    words = ["new", "York", "NEW", "é", "Él", "l'x", "a", "a", "the", "of", "x-y", " z"]
    ends = [" ", " ", " ", " ", "  ", "\t", ", ", ".\n", " \r\n", "!? ", "\x0b"]
    rows = [(k, "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, ""]))
            for k in range(n)]
    return rows + [(k, "one very common passage of words", "en") for k in range(30)] + [
        (None, None, "en"), (7, "", None), (None, "new York new york", "und"), (3, "a a a a a a a a a a", "fr")]


def test_equals_plain_counting(spark, clashing):
    rows = _rows(1)
    df = clashing(spark.createDataFrame(rows, TABLE))
    for name in ("phrase", "n", "size", "key", "pointer", "lang_", "start", "a", "l", "r"):
        df = df.withColumn(name, F.lit(2))
    want = _plain(rows, 5, 20)
    assert len(want) > 30 and _got(df) == want


def test_fingerprints_that_collide_change_nothing(spark):
    rows = _rows(2)
    assert _got(spark.createDataFrame(rows, TABLE), bits=5) == _plain(rows, 5, 20)


def test_words_with_the_same_hash_are_told_apart():
    data = np.frombuffer(b"ab cd ab ef cd ab cd", np.uint8)
    words = phrases._Words(data, np.array([0, len(data)]), np.zeros(1, int), np.zeros(1, np.uint64), 1)
    words.spell()
    assert len({(int(words.word[i]), data[words.start[i]:words.start[i] + 2].tobytes()) for i in range(7)}) == 3
    at, key = words.keys([2])[0]
    first, n = words.groups(2, at, key)
    assert dict(zip(words.phrases(2, first).to_pylist(), n.tolist())) == {"ab cd": 2, "cd ab": 2, "ab ef": 1, "ef cd": 1}


def test_prefix_polynomials_give_the_same_value_anywhere():
    words = np.array([5, 9, 7, 1, 5, 9, 7, 2], np.uint64)
    one, two, three = fingerprints(words, [1, 2, 3])
    assert (one == words).all() and two[0] == two[4] and three[0] == three[4] and len(set(two.tolist())) == 5


def test_places_point_at_an_occurrence_also_in_long_texts(spark, monkeypatch):
    rng = random.Random(5)
    long = " ".join(rng.choice(["aa", "bb", "cc", "dd, ee"]) for _ in range(900_000))
    rows = [(9, long, "en"), (-4, "É. zz yy", "en"), (11, "zz yy", "en"), (None, "no id", "en"), (None, "no id", "en")]
    table = {(r.phrase): r for r in frequent(spark.createDataFrame(rows, TABLE), 2).collect() if r["size"]}
    counts, _ = _grams(rows)
    assert {p: r.n for p, r in table.items()} == {p: n for (_, p), n in counts.items() if n >= 2}
    text = {9: long.encode(), -4: rows[1][1].encode()}
    assert table["no id"].doc_id is None and table["zz yy"].doc_id == -4
    assert all(text[r.doc_id][r.start:].replace(b", ", b" ").startswith(p.encode()) for p, r in table.items() if r.doc_id)


def test_scores_beyond_64_bits_and_ties(spark):
    rows = [(k, "p q. " * 4 + "r s. " * 4, "en") for k in range(10)]
    assert _got(spark.createDataFrame(rows, TABLE)) == _plain(rows, 5, 20)
    big = spark.sql("select cast(1000 as decimal(4,0)) * cast(9e9 as decimal(18,0)) * cast(9e12 as decimal(18,0)) x")
    assert int(big.first().x) == 81 * 10 ** 24


def test_no_rows_and_nothing_frequent(spark):
    assert collocations(spark.createDataFrame([], TABLE)).count() == 0
    assert collocations(spark.createDataFrame([(1, "a b c", "en")], TABLE)).count() == 0
