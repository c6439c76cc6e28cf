"""Quality, toxicity, URL filter and decontamination on planted cases."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from smogcast.llm import queries
from smogcast.llm.decontaminate import align, contaminated
from smogcast.llm.quality import quality
from smogcast.llm.toxicity import (CELLS, EXPRESSION, ORDER, SYMBOLS, _SYMBOL, expressions, grams, likelihoods,
                                   log_ratio, toxicity)
from smogcast.llm.url_filter import host_of, judge_urls, match_rules, path_of

SYLLABLES = ["la", "mo", "ri", "te", "su", "no", "ke", "da", "vi", "po"]


def _word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def _prose(rng, n):
    return " ".join(_word(rng) for _ in range(n))


def test_align_matches_plain_smith_waterman():
    rng = random.Random(1)
    for _ in range(60):
        a = np.array([rng.randrange(6) for _ in range(rng.randint(1, 14))], np.uint64)
        b = np.array([rng.randrange(6) for _ in range(rng.randint(1, 20))], np.uint64)
        table = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = max(0, table[i, j] + (1 if a[i] == b[j] else -0.5), table[i, j + 1] - 0.5, table[i + 1, j] - 0.5)
        score, start, end = align(a, b)
        assert score == table.max()
        assert align(a, b[start:end])[0] == score


def test_contaminated_finds_copies_and_leaves_others(spark, docs, clashing):
    rng = random.Random(2)
    items = [_prose(rng, 40) for _ in range(6)] + ["solo", None, ""]
    texts = [_prose(rng, 200) for _ in range(40)] + [None, ""]
    for i in range(6):
        texts.append(_prose(rng, 50) + ". " + items[i].upper() + " " + _prose(rng, 30))
        edited = items[i].split()
        for k in range(5, 40, 8):
            edited[k] = "zz"
        del edited[20]
        texts.append(_prose(rng, 20) + "\n" + ", ".join(edited) + "! " + _prose(rng, 9))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = contaminated(clashing(docs(texts)), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(42 + k, k // 2) for k in range(12)}
    assert all((r.score == 1.0) == (r.doc_id % 2 == 0) and r.score >= 0.5 for r in got)
    assert contaminated(docs([]), bench).count() == 0 and contaminated(docs(texts), bench.limit(0)).count() == 0


def test_any_edit_equals_aligning_every_item_with_every_document(spark, docs):
    rng = random.Random(12)
    items = [_prose(rng, n) for n in (3, 5, 8, 17, 40, 41)] + ["solo", "two words", "la la la la la la la", ""]
    texts = ["xx solo yy", "SOLO", "two other words", "so two words here", "two", "la " * 40, "", "la"]
    for item in items[:6]:
        words = item.split()
        every = lambda k, f: " ".join(f(w) if n % k == k - 1 else w for n, w in enumerate(words))
        texts += [every(2, lambda w: w + " zz"), every(1, lambda w: w + " zz"), every(4, lambda w: "zz"), every(3, lambda w: ""),
                  " ".join(words[:len(words) // 2]), " ".join(words[-(len(words) // 2):]), " ".join(rng.sample(words, len(words))),
                  " ".join(words[1:] + words[:1]), every(2, lambda w: w + " zz zz zz"), "x " * 30 + every(5, lambda w: "q q")]
    texts = [f"{_prose(rng, rng.randint(0, 30))} {t} {_prose(rng, rng.randint(0, 30))}" if i > 7 else t for i, t in enumerate(texts)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(docs(texts), bench).collect()}
    words = lambda text: np.array([zlib.crc32(w.encode()) for w in text.lower().split()], np.uint64)
    plain = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            n = len(x.split())
            if n and (score := align(words(x), words(t))[0]) >= (n if n < 3 else 0.5 * n) - 1e-9:
                plain[d, i] = score / n
    assert got == plain and len(plain) > 40 and (0, 6) in plain and (2, 7) not in plain


def test_long_texts_are_looked_at_in_stretches(spark, docs, monkeypatch):
    from smogcast.llm import decontaminate
    monkeypatch.setattr(decontaminate, "HITS", 50)
    rng = random.Random(13)
    item = _prose(rng, 30)
    long = " ".join(_word(rng) if k % 700 else item for k in range(30_000)) + " " + "a.b-" * 200_000
    bench = spark.createDataFrame([(1, item), (2, _prose(rng, 25))], "item_id long, text string")
    got = contaminated(docs([long, item]), bench).collect()
    assert {(r.doc_id, r.item_id, r.score) for r in got} == {(0, 1, 1.0), (1, 1, 1.0)}


def test_a_passage_in_most_documents_is_still_found(spark, docs):
    rng = random.Random(3)
    item = _prose(rng, 30)
    texts = [_prose(rng, 40) + " " + item for _ in range(30)] + [_prose(rng, 60) for _ in range(5)]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in contaminated(docs(texts), bench).collect()) == list(range(30))


def test_edited_and_partial_copies_match_brute_force(spark, docs):
    rng = random.Random(4)
    items = [_prose(rng, 36) for _ in range(4)]
    every = lambda text, k: " ".join("zz" if n % k == k - 1 else w for n, w in enumerate(text.split()))
    copies = [f(x) for x in items for f in (lambda x: every(x, 4), lambda x: every(x, 5),
                                            lambda x: " ".join(x.split()[:18]), lambda x: " ".join(x.split()[18:]))]
    inserted = " ".join(w + " zz" if n % 3 == 2 else w for n, w in enumerate(items[0].split()))
    texts = [_prose(rng, 40) + " " + c + " " + _prose(rng, 40) for c in copies + [inserted]]
    texts += [_prose(rng, 60) + " " + " ".join(items[1].split()[:9]) for _ in range(20)]
    texts += [every(items[2], 4) + " " + _word(rng) for _ in range(2000)]     # one edited copy, over and over
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(docs(texts), bench).collect()}
    words = lambda text: np.array([zlib.crc32(w.encode()) for w in text.split()], np.uint64)
    plain = {(d, i): align(words(x), words(t))[0] / 36 for d, t in enumerate(texts[:60]) for i, x in enumerate(items)}
    assert {k: v for k, v in got.items() if k[0] < 60} == {k: v for k, v in plain.items() if v >= 0.5}
    assert {d for d, i in got if i == 2 and d >= 37} == set(range(37, 2037))


def test_quality_separates_junk_on_held_out_rows(spark, docs, clashing):
    rng = random.Random(4)
    texts, good = [], []
    for i in range(300):
        text = _prose(rng, rng.randint(20, 80)).capitalize() + "."
        good.append(i % 4 != 0)
        texts.append(text if good[-1] else "".join(c + rng.choice("%$&#") if c == " " else c for c in text))
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good) if i < 200] + [(None, 1), (3, None)],
                                   "doc_id long, quality int")
    got = {r.doc_id: r for r in quality(clashing(docs(texts + [None, ""])).drop("host", "path"), labels,
                                        F.col("source"), F.col("lang")).collect()}
    assert len(got) == 302
    assert sum(got[i].keep == good[i] for i in range(200, 300)) >= 98
    rates = {r.host_rate for r in got.values()}
    assert all(0.5 < x < 1 for x in rates)           # 0.5 and 1, shrunk to the share of all
    none = quality(docs(texts[:3]), labels.limit(0), F.col("source"), F.col("lang")).collect()
    assert all(abs(r.probability - 0.5) < 1e-9 and r.keep for r in none)
    assert quality(docs([]), labels, F.col("source"), F.col("lang")).count() == 0


def test_log_ratio_is_a_difference_of_distributions():
    rng = np.random.default_rng(1)
    counts = [rng.integers(0, 3, CELLS).astype(float) for _ in range(2)]
    from smogcast.llm import toxicity as T
    lower = np.full((1, SYMBOLS), 1 / SYMBOLS)
    for table in counts:
        assert np.allclose(T._smoothed(table, lower).sum(1), 1)
    assert np.allclose(log_ratio(counts[0], counts[0]), 0)


def test_grams_and_peaks_match_plain_loops():
    rng = random.Random(6)
    texts = ["", "a", "Hello, wörld 42!", _prose(rng, 30)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    cells, ends = grams(data, offsets)
    table = np.random.default_rng(2).normal(size=CELLS).astype(np.float32)
    mean, peak = likelihoods(data, offsets, table)
    for i, t in enumerate(texts):
        line = [26] * (ORDER - 1) + [int(_SYMBOL[b]) for b in t.encode()] + [26]
        want = [sum(line[k + j] * SYMBOLS ** (ORDER - 1 - j) for j in range(ORDER)) for k in range(len(line) - ORDER + 1)]
        assert cells[ends[i]:ends[i + 1]].tolist() == want
        values = table[want].astype(float)
        windows = [values[k:k + 16].sum() / 16 for k in range(len(values) - 15)] or [values.sum() / 16]
        assert abs(mean[i] - values.sum() / max(16, len(values))) < 1e-6 and abs(peak[i] - max(windows)) < 1e-5


def test_toxicity_on_held_out_rows(spark, docs, clashing):
    rng = random.Random(7)
    texts, toxic = [], []
    for i in range(600):
        words = _prose(rng, 40).split()
        toxic.append(i % 5 == 0)
        if toxic[-1]:
            for _ in range(3):
                words[rng.randrange(40)] = "xyzz" + _word(rng)     # compounds seen once
        texts.append(" ".join(words))
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(clashing(docs(texts + [None, ""])), labels).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) for i in range(600))
    assert sum(got[i].predicted == toxic[i] for i in held) >= 0.98 * len(held)
    assert got[600].predicted == got[601].predicted == 0 and 0 <= got[600].score <= 1
    none = toxicity(docs(texts[:2] + [(None, "a")]), labels.limit(0)).collect()
    assert len(none) == 3 and all(r.score == 0 for r in none)
    assert toxicity(docs([]), labels).count() == 0


def test_labels_of_held_out_rows_never_count(spark, docs):
    rng = random.Random(8)
    texts = [_prose(rng, 20) for _ in range(60)]
    one = [(i, i % 2) for i in range(60)]
    two = [(i, y if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - y) for i, y in one]
    runs = [{r.doc_id: round(r.score, 9) for r in toxicity(docs(texts), spark.createDataFrame(x, "doc_id long, toxic int")).collect()}
            for x in (one, two)]
    assert runs[0] == runs[1]


URLS = ["http://Example.ORG/es/5", "https://a.example.org/en/12?x=1", "http://x.org", "http://b.com/fr/1#a", "http://b.com/de",
        "http://b.com/de/", "ftp//none", None, "x://", "http://q.net/p", "http://org/", "http://anorg/es/"]


def test_url_parts_and_rules(spark):
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, action string")
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    frame = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    got = {r.page_id: r for r in match_rules(frame, rules).collect()}
    for i, url in enumerate(URLS):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, a) for h, p, a in queries.URL_RULES
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, None))
        assert (got[i].host, got[i].path, got[i].rule, got[i].action) == (host, path, best[1], best[2]), url


def test_many_rules_are_joined_by_host(spark, monkeypatch):
    from smogcast.llm import url_filter
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, action string")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 3 + ["http://" + "a." * 20_000 + "org/x"])], "page_id long, url string")
    frame = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    few = sorted((r.page_id, r.rule, r.action) for r in match_rules(frame, rules).collect())
    monkeypatch.setattr(url_filter, "SMALL_RULES", 0)
    assert sorted((r.page_id, r.rule, r.action) for r in match_rules(frame, rules).collect()) == few
    assert few[-1][1:] == ("org/", "allow") and match_rules(frame, rules.limit(0)).where("rule is null").count() == len(few)


def test_url_verdicts_on_held_out_hosts_for_each_suffix(spark):
    rng = random.Random(11)
    bad_words = ["cheap-pills", "casino-win", "best-bets", "free-ads-now", "spam-farm", "adult-chat"]
    rows = []
    for i in range(1200):
        bad = i % 6 == 0
        name = f"{rng.choice(bad_words)}{rng.randrange(99) if i % 2 else ''}" if bad else _word(rng) + _word(rng)
        rows.append((i, f"https://{rng.choice(['www.', 'm.', ''])}{name}.example.{('com', 'net')[i % 2]}/{rng.choice(['en', 'es'])}/{i}", int(bad)))
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 0}
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    known = spark.createDataFrame([(u, b) for i, u, b in rows if i not in held], "url string, bad int")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, action string").where("path = '/none/'")
    got = {r.page_id: r.verdict == "block" for r in judge_urls(pages, rules, known).collect()}
    for k in (0, 1):
        mine = [(got[i], bool(b)) for i, _, b in rows if i in held and i % 2 == k]
        good = [x for x, b in mine if not b]
        assert sum(good) <= 0.05 * len(good) and sum(x for x, b in mine if b) >= 0.8 * sum(b for _, b in mine)


def test_url_labels_are_not_the_rules(spark):
    urls = spark.createDataFrame([("http://x.com/de/1",), ("http://x.org/en/1",), ("http://a.casino-win.com/",), (None,)], "url string")
    assert [r.bad for r in queries.url_labels(urls).collect()] == [0, 0, 1, 0]


def test_url_trees_learn_lexical_marks(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        bad = i % 3 == 0
        host = f"{_word(rng)}-{_word(rng)}" if bad else _word(rng) + _word(rng)
        rows.append((i, f"http://{host}.net/{_word(rng)}/{rng.randrange(99)}", int(bad)))
    pages = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (1, "none")], "page_id long, url string")
    known = spark.createDataFrame([(u, b) for _, u, b in rows[:300]] + [("http://a.b/", None)], "url string, bad int")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, action string")
    got = judge_urls(pages, rules, known).collect()
    assert len(got) == 402
    by = {r.page_id: r.verdict for r in got if r.host}
    assert sum((by[i] == "block") == bool(b) for i, _, b in rows[300:]) >= 97
    assert judge_urls(pages.limit(0), rules, known).count() == 0
    assert {r.score for r in judge_urls(pages, rules, known.limit(0)).collect()} == {0.5}


def test_expressions_match_plain_kneser_ney(spark):
    rows = [(1, 900, 40, 800, 30), (2, 2, 60, 0, 55), (3, 0, 1, 0, 0), (4, 5, 0, 4, 0), (5, 0, 0, 0, 9), (6, 3, 2, 0, 0)]
    counts = spark.createDataFrame(rows, "word long, n0 long, n1 long, n2 long, n3 long")
    models = {"ratio": lambda r: (r[1] + r[3], r[2] + r[4]), "ratio0": lambda r: r[1:3], "ratio2": lambda r: r[3:]}
    want = {}
    for name, pick in models.items():
        total, kinds = ([f(pick(r)[k] for r in rows) for k in range(2)] for f in (sum, lambda x: sum(v > 0 for v in x)))
        for r in rows:
            lower = sum(v > 0 for v in pick(r)) / sum(kinds)
            p = [(max(pick(r)[k] - 0.75, 0) + 0.75 * kinds[k] * lower) / total[k] for k in range(2)]
            ratio = np.log(p[1] / p[0]) if lower else 0
            want[r[0], name] = ratio if ratio >= EXPRESSION else 0
    got = {r.word: r for r in expressions(counts).collect()}
    assert set(got) == {w for (w, _), x in want.items() if x > 0}
    assert all(abs(got[w][name] - x) < 1e-9 for (w, name), x in want.items() if w in got)
    assert expressions(counts.where("n1 + n3 = 0")).count() == 0 and expressions(counts.limit(0)).count() == 0


def test_expressions_of_any_script_and_repeated_rows(spark, docs):
    rng = random.Random(8)
    signs = [chr(0x4e00 + k) for k in range(60)]
    texts, toxic = [], []
    for i in range(600):
        words = ["".join(rng.choice(signs) for _ in range(2)) for _ in range(20)]
        toxic.append(i % 5 == 0)
        if toxic[-1]:
            words[rng.randrange(20)] = "毒舌"       # same number of bytes as any other word
        texts.append(" ".join(words))
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    rows = toxicity(docs(texts + [(5, texts[5]), (5, texts[1]), (None, texts[10])]), labels).collect()
    assert len(rows) == 603
    got = {r.doc_id: r for r in rows if r.doc_id != 5}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].predicted == toxic[i] for i in held if i != 5) >= 0.98 * len(held)
    assert sorted(r.predicted for r in rows if r.doc_id == 5) == [0, 1, 1] and got[None].predicted == 1
