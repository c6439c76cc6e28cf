"""Personal data: patterns, and a skip-chain conditional random field for what they miss.

Nodes are the tokens of a document that hold a digit or an ``@``; all other words
are ordinary.  A node's evidence is its shape and the words around it.  Chain
edges join neighbours, skip edges join a token with the one before it, however
far, that has the same letters or the same digits.  Both kinds share one table of
potentials over all documents.  What a pattern found is fixed; loopy
sum-product messages carry it along the edges, so that a number without its plus
sign is judged as its other mentions in the document are.

Weights are those of the pseudo-likelihood: each node's label given its evidence
and the labels of its neighbours, on a sample of documents that the patterns
label (what a pattern dropped for too many digits, as two numbers side by side, teaches
nothing).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables, id_and_text, prepare, utf8

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
#: Documents (in expectation, by a hash of the text), and nodes of each, that the weights are fitted on.
FIT_DOCS, FIT_NODES = 100_000, 64
#: Ordinary words of each of these documents, as examples that are no personal data.
FIT_WORDS = 3
#: Evidence is hashed to so many features; those of the neighbours' labels follow.
EVIDENCE = 1 << 12
#: Rounds of messages, share of the old message that is kept, least probability of an added span.
ROUNDS, DAMP, SURE = 12, 0.3, 0.7
#: Nodes that send messages together; a document with more is its own group.
GROUP_NODES = 1 << 15

# The patterns, written so that every start is tried once.
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TOKEN_CHARS = r"A-Za-z0-9@._%+()\-"
_TOKEN = re.compile(rf"(?<![{_TOKEN_CHARS}])[A-Za-z._%+()\-]*+[0-9@][{_TOKEN_CHARS}]*+")
_WORD = re.compile(r"[^\W\d_]+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _is_number(text: str) -> bool:
    return text.isascii() and text.isdigit()


def patterns(text: str, unsure: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(label, start, end) of all that the patterns find, by kind, then start.

    ``unsure`` gets the spans of matches that were dropped for too many digits: they
    may hold several numbers, of which the patterns say nothing.
    """
    out, last = [], 0
    dropped = [] if unsure is None else unsure
    for found in _AT.finditer(text):
        start = at = found.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            out.append((1, start, found.end()))
            last = found.end()
    for found in _IP.finditer(text):
        if all(map(_small, found.group().split("."))):
            out.append((2, *found.span()))
    for found in _CARD.finditer(text):
        digits = re.sub("[ -]", "", found.group())
        if len(digits) > 19:
            dropped.append(found.span())
        elif len(digits) >= 16 and _luhn(digits):
            out.append((3, *found.span()))
    for found in _PHONE.finditer(text):
        digits = sum(c.isdigit() for c in found.group())
        if digits > 15:
            dropped.append(found.span())
        elif digits >= 8:
            out.append((4, *found.span()))
    return out


#: Most digits of a card and of a phone number.
_MOST = {3: 19, 4: 15}


class Graph:
    """Nodes and edges of one document: spans, evidence, fixed labels, chain and skip edges."""

    def __init__(self, text: str):
        unsure: list[tuple[int, int]] = []
        self.base = patterns(text, unsure)
        self.spans = list(self._tokens(text))
        self.fixed = self._overlaps(reversed(self.base))
        self.unsure = (self._overlaps((1, a, b) for a, b in unsure) > 0) & (self.fixed == 0)
        self.chain, self.skip = [], []
        seen: dict[str, int] = {}
        for i, (a, b) in enumerate(self.spans):
            if i and a - self.spans[i - 1][1] <= 2:
                self.chain.append((i - 1, i))
            before = {seen[key] for key in self._keys(text[a:b]) if key in seen}
            self.skip += [(j, i) for j in sorted(before)]
            for key in self._keys(text[a:b]):
                seen[key] = i
        self.shapes = [shape(text[a:b]) for a, b in self.spans]

    @staticmethod
    def _tokens(text: str) -> Iterator[tuple[int, int]]:
        for found in _TOKEN.finditer(text):
            a, b = found.span()
            while b > a and text[b - 1] in "._%+(-@":
                b -= 1
            while a < b and text[a] in "._%)-":
                a += 1
            if a < b:
                yield a, b

    @staticmethod
    def _keys(token: str) -> list[str]:
        """What makes tokens the same or similar: letters, six digits or more, the part before ``@``."""
        keys = ["=" + token.lower()]
        digits = re.sub("[^0-9]", "", token)
        if len(digits) >= 6:
            keys.append("9" + digits)
        name = token.lower().partition("@")[0]
        if len(name) >= 4 and not name.isdigit():
            keys.append("@" + name)
        return keys

    def _overlaps(self, spans) -> np.ndarray:
        """Label of the last of ``spans`` (label, start, end) that a token overlaps, else 0."""
        out = np.zeros(len(self.spans), np.int64)
        starts = np.array([a for a, _ in self.spans], np.int64)
        ends = np.array([b for _, b in self.spans], np.int64)
        for label, a, b in spans:
            out[np.searchsorted(ends, a, "right"):np.searchsorted(starts, b, "left")] = label
        return out

    def evidence(self, text: str, i: int) -> list[int]:
        beside = lambda j: self.shapes[j] if 0 <= j < len(self.spans) else ""
        near = lambda j: abs(self.spans[max(i, j)][0] - self.spans[min(i, j)][1]) <= 2 if 0 <= j < len(self.spans) else False
        return evidence(text, *self.spans[i], beside(i - 1) if near(i - 1) else "", beside(i + 1) if near(i + 1) else "")


def shape(token: str) -> str:
    """Runs of digits as 9, of letters as a; other characters stay."""
    return re.sub("[A-Za-z]+", "a", re.sub("[0-9]+", "9", token[:64]))


def evidence(text: str, a: int, b: int, before: str = "", after: str = "") -> list[int]:
    """Hashed features of the token at a..b, between tokens of the shapes ``before`` and ``after``."""
    token = text[a:min(b, a + 64)]
    runs = re.sub("[0-9]+", lambda m: f"<{min(len(m.group()), 20)}>", re.sub("[A-Za-z]+", "a", token))
    digits = sum(c.isdigit() for c in token)
    left, right = text[max(0, a - 24):a].split(), text[b:b + 24].split()
    bare, parts = re.sub("[ -]", "", token), token.split(".")
    card = _is_number(bare) and 16 <= len(bare) <= 19 and _luhn(bare)
    valid = f"{card}{all(_is_number(x) and _small(x) for x in parts)}{min(len(parts), 5)}"
    values = ("s" + shape(token), "r" + runs, f"d{min(digits, 20)}", f"n{digits > 0}{'@' in token}{min(token.count('.'), 4)}",
              "p" + before, "f" + after, "v" + valid, "l" + (left[-1].lower() if left else ""), "w" + (right[0].lower() if right else ""),
              f"c{sum(c.isalpha() for c in token) > 0}{'-' in token}{'(' in token}{'+' in token}")
    return sorted({zlib.crc32(v.encode()) % EVIDENCE for v in values})


def _examples(batches):
    """(label, indices, values) of the nodes of sampled documents and of some ordinary words."""
    for batch in batches:
        labels, indices, values = [], [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            graph = Graph(text)
            around: list[list[tuple[int, float]]] = [[] for _ in graph.spans]
            known = ~graph.unsure
            for pairs, to_later, to_earlier in ((graph.chain, 0, LABELS), (graph.skip, 2 * LABELS, 2 * LABELS)):
                for i, j in pairs:
                    if known[i] and known[j]:
                        around[j].append((to_later + int(graph.fixed[i]), 1.0))
                        around[i].append((to_earlier + int(graph.fixed[j]), 1.0))
            step = max(1, -(-len(graph.spans) // FIT_NODES))
            rows = [(int(graph.fixed[i]), graph.evidence(text, i), around[i])
                    for i in range(0, len(graph.spans), step) if known[i]]
            head = [m.span() for m in _WORD.finditer(text[:4096])]
            for a, b in head[::max(1, len(head) // FIT_WORDS)][:FIT_WORDS]:
                rows.append((0, evidence(text, a, b), []))
            for label, own, others in rows:
                total: dict[int, float] = dict.fromkeys(own, 1.0)
                for k, v in others:
                    total[EVIDENCE + k] = total.get(EVIDENCE + k, 0.0) + v
                labels.append(float(label))
                indices.append(sorted(total))
                values.append([total[k] for k in sorted(total)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(labels, pa.float64()), pa.array(indices, pa.list_(pa.int32())),
             pa.array(values, pa.list_(pa.float64()))], ["label", "at", "value"])


class Weights:
    """Evidence weights [features, labels], and potentials of chain and skip edges [labels, labels]."""

    def __init__(self, coefficients: np.ndarray, intercepts: np.ndarray, known: np.ndarray):
        full = np.zeros((LABELS, EVIDENCE + 3 * LABELS))
        full[:len(coefficients)] = coefficients
        self.bias = np.full(LABELS, -30.0)
        self.bias[:len(intercepts)] = intercepts
        self.bias[~known] = -30.0
        self.own = full[:, :EVIDENCE].T.copy()
        before, after, skip = (full[:, EVIDENCE + k * LABELS:EVIDENCE + (k + 1) * LABELS] for k in range(3))
        # of a pair, the earlier node sees the later one after it and the later one the earlier before it
        self.chain, self.skip = (after + before.T) / 2, (skip + skip.T) / 2


def marginals(unary: np.ndarray, edges: np.ndarray, kind: np.ndarray, potentials: list[np.ndarray]) -> np.ndarray:
    """Marginals of the labels of each node by loopy sum-product.

    ``unary`` [nodes, labels], edges (i, j) of ``kind`` k with the potential
    ``potentials[k][label of i, label of j]``, all logarithms.  Exact on trees of
    at most ROUNDS steps (without damping, nearly so with it).
    """
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    m, n = len(edges), len(unary)
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    table = np.stack([*potentials, *[p.T for p in potentials]])
    which = np.concatenate([kind, kind + len(potentials)])
    message = np.zeros((2 * m, unary.shape[1]))

    def belief():
        out = unary.copy()
        for y in range(out.shape[1]):
            out[:, y] += np.bincount(target, message[:, y], n)
        return out

    for _ in range(ROUNDS if m else 0):
        cavity = belief()[source] - message[back]
        new = np.empty_like(message)
        for y in range(new.shape[1]):
            new[:, y] = np.logaddexp.reduce(cavity + table[which, :, y], axis=1)
        new -= new.max(axis=1, keepdims=True)
        message = DAMP * message + (1 - DAMP) * new
    out = belief()
    out = np.exp(out - out.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def label(graphs: list[Graph], texts: list[str], weights: Weights) -> list[np.ndarray]:
    """Marginals of the nodes of several documents, which share no edge."""
    sizes = np.cumsum([0, *(len(g.spans) for g in graphs)])
    unary = np.zeros((int(sizes[-1]), LABELS))
    edges, kind = [], []
    for graph, text, first in zip(graphs, texts, sizes.tolist()):
        for i in range(len(graph.spans)):
            unary[first + i] = weights.bias + weights.own[graph.evidence(text, i)].sum(axis=0)
        some = np.flatnonzero(graph.fixed)
        unary[first + some] = -1e4
        unary[first + some, graph.fixed[some]] = 0
        for k, pairs in enumerate((graph.chain, graph.skip)):
            edges += [(first + i, first + j) for i, j in pairs]
            kind += [k] * len(pairs)
    got = marginals(unary, np.array(edges, np.int64).reshape(-1, 2), np.array(kind, np.int64), [weights.chain, weights.skip])
    return [got[a:b] for a, b in zip(sizes[:-1], sizes[1:])]


def added(graph: Graph, text: str, probability: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(label, start, end, probability) of the nodes judged personal data that no pattern touched.

    Neighbours judged card or phone are one span, while it has no more digits than one may have.
    """
    best, out = probability.argmax(axis=1), []
    digits = lambda a, b: sum(c.isdigit() for c in text[a:b])
    joined = {j for _, j in graph.chain}
    for i, (a, b) in enumerate(graph.spans):
        kind, p = int(best[i]), float(probability[i, best[i]])
        if not kind or p < SURE or graph.fixed[i]:
            continue
        if kind in _MOST and i in joined and out and out[-1][0] == kind and out[-1][4] == i - 1 and (
                digits(out[-1][1], b) <= _MOST[kind]):
            out[-1] = (kind, out[-1][1], b, min(out[-1][3], p), i)
        else:
            out.append((kind, a, b, p, i))
    return [x[:4] for x in out]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                             ("base", pa.bool_()), ("probability", pa.float64())]))


def _finder(weights):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            marked = np.concatenate([[0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64))])
            rows = np.flatnonzero(marked[offsets[1:]] > marked[offsets[:-1]])
            out: list[list] = [[] for _ in range(len(offsets) - 1)]
            held: list[tuple[int, str, Graph]] = []

            def judge():
                found = [[] for _ in held] if weights is None else [
                    added(graph, text, p) for (_, text, graph), p in zip(held, label(
                        [g for _, _, g in held], [t for _, t, _ in held], weights.value))]
                for (row, _, graph), more in zip(held, found):
                    spans = [(k, a, b, True, 1.0) for k, a, b in graph.base] + [(k, a, b, False, p) for k, a, b, p in more]
                    out[row] = [{"kind": KINDS[k - 1], "start": a, "end": b, "base": base, "probability": p}
                                for k, a, b, base, p in sorted(spans)]
                held.clear()

            size = 0
            for row in rows.tolist():
                text = batch.column("text")[row].as_py()
                held.append((row, text, Graph(text)))
                size += len(held[-1][2].spans)
                if size >= GROUP_NODES:
                    judge()
                    size = 0
            judge()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, _SPANS)], ["doc_id", "spans"])

    return run


def fit(docs: DataFrame) -> Weights | None:
    """Weights from a sample of (doc_id, text); null where the patterns find nothing in it."""
    rows = docs.count()
    if not rows:
        return None
    bound = int(min(1.0, FIT_DOCS / rows) * (1 << 20))
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < bound)
    nodes = Tables(docs.sparkSession, "pii").store(
        sample.mapInArrow(_examples, "label double, at array<int>, value array<double>"), "nodes")
    counts = {int(r["label"]): r["count"] for r in nodes.groupBy("label").count().collect()}
    if 0 not in counts or len(counts) < 2:
        return None
    vector = F.udf(lambda at, value: SparseVector(EVIDENCE + 3 * LABELS, at, value), VectorUDT())
    model = LogisticRegression(featuresCol="features", labelCol="label", family="multinomial", regParam=1e-3, maxIter=60,
                               standardization=False).fit(nodes.select("label", vector("at", "value").alias("features")))
    known = np.array([k in counts for k in range(LABELS)])
    return Weights(model.coefficientMatrix.toArray(), model.interceptVector.toArray(), known)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for each row; spans are (kind, start, end, base, probability) by kind, then start.

    Places count code points, the end is exclusive.  ``base`` spans are those of the
    patterns, leftmost and not overlapping within a kind; the others are the
    field's, where its marginal is SURE or more, and touch no base span.  The
    weights come from at most FIT_DOCS documents; each whole text is judged.

    A null or empty text has no spans.  Null and repeated ids and repeated rows are
    judged one by one, by their text alone.  Nodes of a long text are as many as
    its tokens with digits or ``@``, with at most four edges each.  Without rows, or
    where the patterns find nothing to learn from, only base spans are returned.
    Other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = id_and_text(docs, id_col, text_col)
    weights = fit(rows)
    return rows.mapInArrow(_finder(weights if weights is None else spark.sparkContext.broadcast(weights)),
                           "doc_id long, spans array<struct<kind string, start long, end long, base boolean, probability double>>")
