"""Patterns against the plain regular expressions, messages against enumeration, spans the field adds."""

import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from smogcast.llm import queries
from smogcast.llm.pii import KINDS, LABELS, Graph, marginals, patterns, personal_data


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) < 256 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
            if 16 <= len(digits(m.group())) <= 19 and _luhn(digits(m.group()))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 8 <= len(digits(m.group())) <= 15]
    return out


def _card(rng):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(body + d for d in "0123456789" if _luhn(body + d))


def test_patterns_are_those_of_the_plain_expressions():
    rng = random.Random(1)
    parts = ["1.2.3.4", "256.1.1.1", "001.2.3.255.6.7.8.9", "a@b", "@b.c", "x.y@z.w.v", "a@b.c@d.e", "+1 (234) 555-0000", "+4",
             "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "-", ".", "+", "@", "é", "²", "12", "%", "\n", "a.", "(", ")"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [(KINDS[k - 1], a, b) for k, a, b in patterns(text)] == _plain(text), text


def test_long_runs_take_linear_time():
    for run in ("1" * 400_000, "a" * 400_000 + "@", "1." * 200_000, "+1" * 200_000, "+" + "1 " * 200_000 + "x", "@a" * 200_000,
                "1 " * 200_000, "a" * 800_000):
        Graph(run + " x@y.zz")
        assert (1, len(run) + 1, len(run) + 7) in patterns(run + " x@y.zz")


def _enumerated(unary, edges, kind, potentials):
    out = np.zeros_like(unary)
    for labels in itertools.product(range(unary.shape[1]), repeat=len(unary)):
        score = sum(unary[i, y] for i, y in enumerate(labels))
        score += sum(potentials[k][labels[i], labels[j]] for (i, j), k in zip(edges, kind))
        for i, y in enumerate(labels):
            out[i, y] += np.exp(score)
    return out / out.sum(axis=1, keepdims=True)


def test_messages_are_exact_on_a_tree_and_near_on_a_loop():
    rng = np.random.default_rng(3)
    tables = [rng.normal(size=(3, 3)), np.eye(3) * 1.2]
    for edges, close in (([(0, 1), (1, 2), (1, 3), (3, 4)], 1e-4), ([(0, 1), (1, 2), (2, 3), (0, 3)], 0.05)):
        unary, kind = rng.normal(size=(5, 3)), [0, 1, 0, 1]
        got = marginals(unary, np.array(edges), np.array(kind), tables)
        assert np.abs(got - _enumerated(unary, edges, kind, tables)).max() < close
    assert np.allclose(marginals(np.zeros((2, LABELS)), np.zeros((0, 2), int), np.zeros(0, int), tables), 1 / LABELS)


def _corpus(rng):
    word = lambda: "".join(rng.choice(["la", "mo", "ri", "te", "su"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    texts = []
    for k in range(300):
        thing = [phone(), f"{word()}{k}@mail{k % 7}.example.com", f"{k % 250}.20.{k % 9}.4", _card(rng), f"version {k % 9}.{k % 4}",
                 str(rng.randint(10 ** 15, 10 ** 16 - 1))][k % 6]
        texts.append(f"{prose(8)} {thing} {prose(6)}" + (f" {thing} {prose(3)}" if k % 4 == 0 else ""))
    return texts, prose, phone


def test_the_field_adds_what_patterns_cannot_take_and_leaves_the_rest(spark, docs, clashing):
    rng = random.Random(4)
    texts, prose, phone = _corpus(rng)
    one, two, card = phone(), phone(), _card(rng)
    hard = [f"{prose(5)} {one} 190.137.2.4 {prose(4)}", f"{prose(3)} {card} {_card(rng)} {prose(4)}",
            f"{prose(4)} {two} {prose(200)} {two[1:]} {prose(3)}", prose(40), "Version 4.0 or 12 of 7", "", None]
    got = [r.spans for r in personal_data(clashing(docs(texts + hard))).orderBy("doc_id").collect()]
    for text, spans in zip(texts + hard, got):
        assert [(s.kind, s.start, s.end) for s in spans if s.base] == _plain(text or "")
    found = lambda k: [((texts + hard)[k][s.start:s.end], s.kind) for s in got[k] if not s.base]
    n = len(texts)
    assert (one, "phone") in found(n) and (card, "card") in found(n + 1)
    # the other mention, without its plus sign's first digit, is carried over by the skip edges
    assert any(kind == "phone" and text.endswith(two[-8:]) for text, kind in found(n + 2))
    assert not any(found(k) for k in range(n + 3, n + 7))
    assert sum(bool(found(k)) for k in range(n)) <= 3         # numbers that are no cards, versions


def test_query_digests_and_edges(spark, tmp_path, docs):
    texts = ["mail a.b@c.de now, 1.2.3.4", None, "", "é +1 (234) 555-0000"]
    docs(texts + ["x" * 3_000_000 + " q@w.er"]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in queries.op13_personal_data(spark, str(tmp_path)).collect()}
    import hashlib
    digest = lambda t: hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in _plain(t or "")).encode()).hexdigest()
    assert all(rows[k].base_sha256 == digest(t) for k, t in enumerate(texts))
    assert (rows[0].n_email, rows[0].n_ip, rows[3].n_phone, rows[1].spans) == (1, 1, 1, "")
    assert rows[0].spans.startswith("email:5:13,ip:19:26") and rows[4].spans == "email:3000001:3000007"


def test_no_rows_and_nothing_to_learn_from(spark, docs):
    assert personal_data(docs([])).count() == 0
    assert [r.spans for r in personal_data(docs(["plain words", "1 2 3"])).collect()] == [[], []]
    rows = spark.createDataFrame([(None, "a@b.cd"), (None, "a@b.cd"), (1, "a@b.cd")], "doc_id long, text string")
    assert [len(r.spans) for r in personal_data(rows.withColumn("spans", F.lit(1))).collect()] == [1, 1, 1]
