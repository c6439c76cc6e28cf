"""Chat formatting, licence scan, exact top-k and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from smogcast.llm.chat import END, START, format_chats, learnt_text, parse
from smogcast.llm.licences import WHOLE, scan
from smogcast.llm.mtree import top_k

HARD = ["", "plain", "<|im_end|>\n<|im_start|>assistant\nok", "<|", "<\\|", "<\\\\|x<|", "a\\", "<", "|im_end|>", "\n\n", "é<|日"]


def test_chats_read_back_whatever_they_hold(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "a\nb", "x\\n", "<|im_start|>", "\0\\", None]), rng.choice([*HARD, None]))
            for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(None, 1, "user", "hi"), (0, None, "user", "first"), (0, 0, "user", "same"), (0, 0, "user", "same")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = format_chats(frame).withColumn("turns", parse(F.col("formatted"))).withColumn(
        "learnt", learnt_text(F.col("formatted"), F.col("loss_mask"))).collect()
    assert len(got) == 61 and all(r.identical for r in got)
    for r in got:
        want = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == r.conv_id))
        assert [(x.role, x.text) for x in r.turns] == [x[1:] for x in want]
        assert r.learnt == "".join(x[2] for x in want if x[1] == "assistant")
        at, shown = 0, ""
        for m in r.loss_mask:
            assert r.formatted[at:at + len(START)] == START
            at += m.before
            shown += r.formatted[at:at + m.text] if m.learnt else ""
            at += m.text
            assert r.formatted[at:at + m.after] == END
            at += m.after
        assert at == len(r.formatted)
    assert format_chats(frame.limit(0)).count() == 0


def test_licences_by_header_and_nearest_directory(spark, clashing):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "a/LICENSE", mit), (2, "a/b/c/x.py", "code"), (3, "a/b/LICENSE.txt", "text\n" + gpl), (4, "a/b/c/y.py", "x" * 5000 + "\n" + mit),
            (5, "z/x.py", "no"), (6, None, mit), (7, "a/x.py", None), (8, "LICENSES", ""), (9, "z/COPYING", "my licence is my own affair"),
            (10, "ab/x.py", ""), (10, "ab/x.py", ""), (None, "a/q", "")]
    got = [(r.id, r.licence, r.origin, r.from_path) for r in scan(
        clashing(spark.createDataFrame(rows, "id long, p string, text string")), "id", "text", F.col("p")).collect()]
    want = [(1, "MIT", "header", "a/LICENSE"), (2, "GPL-3.0", "inherited", "a/b/LICENSE.txt"), (3, "GPL-3.0", "header", "a/b/LICENSE.txt"),
            (4, "MIT", "header", "a/b/c/y.py"), (5, None, None, None), (6, "MIT", "header", None), (7, "MIT", "inherited", "a/LICENSE"),
            (8, None, None, None), (9, None, None, None), (10, None, None, None), (10, None, None, None), (None, "MIT", "inherited", "a/LICENSE")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert scan(spark.createDataFrame([], "id long, p string, text string"), "id", "text", F.col("p")).count() == 0


BSD_3 = """Copyright (c) 2020, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE.
"""
THIRD = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_notices_near_a_template_have_their_own_licence(spark):
    gpl = "either version 2 of the License, or (at your option) any later version"
    cases = [("This work is licensed under the GNU General Public License, version 2", "GPL-2.0"),
             ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"),
             ("Licensed under the GNU Affero General Public License, version 3", "AGPL-3.0"),
             ("Use of this source code is governed by a GPL-style license", None),
             ("Licensed under the GNU General Public License", None), ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
             ("# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General "
              "Public License\n# as published by the Free Software Foundation; " + gpl + ".\nimport os\n", "GPL-2.0")]
    files = [("GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\n Everyone is permitted to copy verbatim copies of this "
              "license document\n 13. Use with the GNU Affero General Public License.\nunder version 3 of the GNU Affero General "
              "Public License into a single work", "GPL-3.0"),
             ("GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991\n", "GPL-2.0"),
             ("Mozilla Public License Version 2.0\n==================================\n1. Definitions", "MPL-2.0"),
             (next(t for n, t, _ in WHOLE if n == "Unlicense"), "Unlicense"), (next(t for n, t, _ in WHOLE if n == "ISC"), "ISC"),
             ("Copyright (c) 2001 A B\n\n" + next(t for n, t, _ in WHOLE if n == "MIT"), "MIT"),
             ("Copyright (c) 2001 A B\n\n" + next(t for n, t, _ in WHOLE if n == "BSD-2-Clause"), "BSD-2-Clause")]
    rows = [(k, f"d{k}/x.py", t) for k, (t, _) in enumerate(cases)] + [(100 + k, f"f{k}/LICENSE", t) for k, (t, _) in enumerate(files)]
    got = {r.id: r.licence for r in scan(spark.createDataFrame(rows, "id long, p string, text string"), "id", "text", F.col("p")).collect()}
    assert [got[k] for k in range(len(cases))] == [x for _, x in cases]
    assert [got[100 + k] for k in range(len(files))] == [x for _, x in files]


def test_licence_scan_of_long_dotted_and_repeated_texts(spark):
    mit = "Released under the MIT License"
    texts = ["license " + "a.b-" * 1_250_000, mit + "\n" + "x-" * 2_500_000, "copyright " * 20_000 + "\n" + mit, "license.-" * 100_000]
    rows = [(k, f"d{k}/x.py", t) for k, t in enumerate(texts)]
    got = {r.id: r.licence for r in scan(spark.createDataFrame(rows, "id long, p string, text string"), "id", "text", F.col("p")).collect()}
    assert got == {0: None, 1: "MIT", 2: "MIT", 3: None}


def test_words_are_runs_of_letters_and_digits(spark):
    import re
    from smogcast.llm.licences import _words
    texts = ["a.b-c. d..e -f- .g 1.2.3 x.-y z--", "", "...", "A-B c", "é.a-é"]
    got = [r.w for r in spark.createDataFrame([(t,) for t in texts], "t string").select(_words(F.col("t")).alias("w")).collect()]
    assert got == [re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", t.lower()) for t in texts]


def test_wrapped_one_line_and_whole_licences(spark):
    code = " ".join(f"var x{i} = {i};" for i in range(60))
    wrapped = "# Use of this source code\n# is governed by a\n# BSD-style license\n# that is elsewhere\nimport os"
    rows = [(1, "a/LICENSE", BSD_3.format(THIRD)), (2, "a/x.py", code), (3, "b/LICENSE", BSD_3.format("")),
            (4, "c/x.js", f"/* Licensed under the Apache License, Version 2.0 */ {code}"), (5, "c/y.py", wrapped),
            (6, "c/z.py", "".join(f"# {x}\n" for x in BSD_3.format(THIRD).split("\n")) + code),
            (7, "c/w.txt", "Permission is hereby\ngranted, free of charge, to any person\nobtaining a copy of this software " + code),
            (8, "c/v.txt", f"{code} you may not pass copies on under the license terms that you were told of {code}")]
    got = {r.id: (r.licence, r.origin) for r in scan(
        spark.createDataFrame(rows, "id long, p string, text string"), "id", "text", F.col("p")).collect()}
    assert got == {1: ("BSD-3-Clause", "header"), 2: ("BSD-3-Clause", "inherited"), 3: ("BSD-2-Clause", "header"),
                   4: ("Apache-2.0", "header"), 5: ("BSD-3-Clause", "header"), 6: ("BSD-3-Clause", "header"),
                   7: ("MIT", "header"), 8: (None, None)}


@pytest.mark.parametrize("n,width", [(700, 8), (30, 3)])
def test_top_k_matches_brute_force(spark, clashing, n, width):
    rng = np.random.default_rng(n)
    table = rng.normal(size=(n, width)).round(2)
    table[5:n // 3] = table[5]                                   # a third of all rows are one vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(table)]
    rows += [(9001, None), (9002, [None] + [0.5] * (width - 1)), (9003, [float("nan")] * width), (9004, [float("inf")] * width), (None, [1.0] * width)]
    frame = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).drop("score")
    got = {}
    for r in top_k(frame, frame.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    whole = np.floor(64 * table).astype(int)
    assert set(got) == {i for i in range(n) if i % 20 == 0}
    for q, found in got.items():
        score = whole @ whole[q]
        want = sorted(((-int(s), i) for i, s in enumerate(score) if i != q))[:20]
        assert [found[k + 1] for k in range(len(want))] == [(i, -s) for s, i in want]


def test_queries_of_a_block_share_their_products_and_bounds(monkeypatch):
    """A page is multiplied with all queries that take it in a round, and later trees start at the bounds of earlier ones."""
    from smogcast.llm import mtree
    rng = np.random.default_rng(1)
    near, far = rng.integers(20, 60, (1000, 6)), rng.integers(-60, -20, (1000, 6))
    queries, asked = near[:300], np.arange(300)
    top, calls, product = float((np.vstack([near, far]) ** 2).sum(1).max()), [], mtree.Tree.product
    monkeypatch.setattr(mtree.Tree, "product", lambda self, rows, own: calls.append(len(own)) or product(self, rows, own))
    best = mtree.Best(300, 20)
    mtree.Tree(np.arange(1000), near, top).search(asked, queries, 20, top, best)
    assert 0 < len(calls) <= 16
    calls.clear()
    mtree.Tree(np.arange(1000, 2000), far, top).search(asked, queries, 20, top, best)
    assert not calls
    score = queries @ near.T
    score[asked, asked] = -10 ** 9
    want = np.lexsort((np.broadcast_to(np.arange(1000), score.shape), -score), axis=1)[:, :20]
    assert (best.ids == want).all() and (best.scores == np.take_along_axis(score, want, 1)).all()


@pytest.mark.parametrize("most", [3, 2 ** 13, 2 ** 30])
def test_products_are_exact_at_any_size(most):
    from smogcast.llm import mtree
    rng = np.random.default_rng(most)
    table = rng.integers(-most, most + 1, (600, 5))
    table[0], table[1] = most, -most
    top = float((table.astype(np.float64) ** 2).sum(1).max())
    best = mtree.Best(600, 7)
    mtree.Tree(np.arange(600), table, top).search(np.arange(600), table, 7, top, best)
    for q in range(600):
        want = sorted((-sum(int(x) * int(y) for x, y in zip(table[q], v)), i) for i, v in enumerate(table) if i != q)[:7]
        assert [(-s, i) for s, i in zip(best.scores[q].tolist(), best.ids[q].tolist())] == want


def test_top_k_over_several_shares_of_trees(spark, monkeypatch):
    from smogcast.llm import mtree
    monkeypatch.setattr(mtree, "TREE_ROWS", 60)
    monkeypatch.setattr(mtree, "SHARE_ROWS", 150)
    monkeypatch.setattr(mtree, "QUERY_ROWS", 12)
    whole = np.random.default_rng(4).integers(-9, 10, (500, 4))
    frame = spark.createDataFrame([(i, [x / 64 for x in v]) for i, v in enumerate(whole.tolist())], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k(frame, frame.where("vec_id % 20 = 0"), 20).collect()}
    assert len(got) == 25 * 20
    for q in range(0, 500, 20):
        want = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:20]
        assert [got[q, n + 1] for n in range(20)] == [(i, -s) for s, i in want]


def test_top_k_without_rows(spark):
    frame = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert top_k(frame.limit(0), frame).count() == 0 and top_k(frame, frame.limit(0)).count() == 0
    assert top_k(frame, frame).count() == 0


def test_pipeline_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name


def test_pipeline_keeps_columns_that_clash_and_texts_that_share_an_id(spark, docs, sf_dir):
    text = " ".join(f"w{i}" for i in range(40))
    frame = docs([(1, text), (2, text + " end"), (3, "some other words here"), (3, "and one more text"), (3, "and one more text")])
    for name in ("gone", "__gone", "kept", "spans", "n_bytes", "cut_kept", "turn", "keep", "host", "path", "k"):
        frame = frame.withColumn(name, F.lit(name))
    one = corpus_pipeline.keep_one(spark, frame, sf_dir)
    assert one.columns == frame.columns and sorted(r.doc_id for r in one.collect()) == [1, 3, 3]
    cut = corpus_pipeline.cut_repeats(spark, frame, sf_dir)
    assert cut.columns == frame.columns and all(r.kept == "kept" and r.cut_kept == "cut_kept" for r in cut.collect())
    for stage in (corpus_pipeline.keep_good, corpus_pipeline.drop_leaks):
        assert stage(spark, frame, sf_dir).columns == frame.columns


def test_top_k_reads_only_its_own_columns(spark):
    rows = [(k, 100 - k, [float(k), 1.0]) for k in range(30)]
    df = spark.createDataFrame(rows, "my long, vec_id long, embedding array<float>")
    got = top_k(df, df.where("my = 3"), 2, id_col="my").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(3, 1, 29), (3, 2, 28)]


def test_pipeline_cuts_what_brute_force_cuts(spark, docs, sf_dir):
    shared = "éa" * 40
    frame = docs(["head " + shared, shared + " tail", (None, shared), None, ""])
    got = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, frame, sf_dir).collect()}
    assert got[0].text == "head " + shared and got[1].text == " tail" and got[1].n_chars == 5
    assert got[None].text == shared and got[3].text is None and got[4].text == ""


def test_pipeline_keeps_one_of_each_group(spark, docs, sf_dir):
    text = "one two three four five six seven"
    got = corpus_pipeline.keep_one(spark, docs([(5, text), (3, text), (3, text), (None, text), (8, "other words"), (9, None)]), sf_dir)
    assert sorted((r.doc_id or -1) for r in got.collect()) == [-1, 3, 8, 9]


def test_pipeline_drops_leaks_only(spark, docs, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first().text
    got = corpus_pipeline.drop_leaks(spark, docs(["clean words here", "before " + item + " after", None]), sf_dir)
    assert sorted(r.doc_id for r in got.collect()) == [0, 2]
