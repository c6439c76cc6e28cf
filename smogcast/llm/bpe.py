"""Byte-level BPE encoding with tiktoken and a local rank file, and raw-byte decoding."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .shared import id_and_text, prepare

#: Longer texts are split; longer runs of white space are encoded on their own.
LONG_TEXT, LONG_SPACE = 1 << 16, 1 << 12
#: A rank file is a fixed vocabulary; one of more bytes than this isn't broadcast.
MOST_RANK_BYTES = 64 << 20

#: The characters with the Unicode property White_Space.
_WHITE = "\t-\r \x85\xa0  -     　"
_LONG_RUN = re.compile(f"[{_WHITE}]{{{LONG_SPACE},}}")
_SAFE = re.compile(r"(?<=\w)(?=[ \n])")


def split(text: str) -> Iterator[tuple[str, bool]]:
    """Pieces of a long text that encode as they do within it, and whether each is one match.

    A match of the pattern that holds a word character never goes on into white
    space, and the pattern never looks back: so a text may be cut between a word
    character and a space or line end.  A long run of white space is one match
    but for its last character when something follows.
    """
    at = 0
    for run in _LONG_RUN.finditer(text):
        yield from ((x, False) for x in _parts(text, at, run.start()))
        at = run.end() - (run.end() < len(text))
        yield text[run.start():at], True
    yield from ((x, False) for x in _parts(text, at, len(text)))


def _parts(text: str, at: int, to: int) -> Iterator[str]:
    while to - at > LONG_TEXT and (cut := _SAFE.search(text, at + LONG_TEXT, to)):
        yield text[at:cut.start()]
        at = cut.start()
    if at < to:
        yield text[at:to]


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def encode(text: str, encoding: tiktoken.Encoding) -> list[int]:
    if len(text) < LONG_SPACE:
        return encoding.encode_ordinary(text)
    out = []
    for piece, one in split(text):
        out += encoding._encode_single_piece(piece) if one else encoding.encode_ordinary(piece)
    return out


def _coded(ranks, pattern: str):
    def run(batches):
        encoding = _encoding(ranks.value, pattern)
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch.column("text"):
                found = encode(text.as_py() or "", encoding)
                n.append(len(found))
                ids.append(np.array(found, "<u4").tobytes())
                decoded.append(encoding.decode_bytes(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
                 pa.array(decoded, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for each row.

    ``ids`` holds the token ids of the whole text as little-endian unsigned
    32-bit integers, ``decoded`` the bytes they stand for.  Special tokens in a
    text are ordinary text.  A null or empty text has no ids; a row is a row,
    also with a null or repeated id.
    """
    spark = docs.sparkSession
    prepare(spark)
    with open(ranks_path, "rb") as file:
        ranks = file.read(MOST_RANK_BYTES + 1)
    if len(ranks) > MOST_RANK_BYTES:
        raise ValueError(f"{ranks_path} is larger than a rank file may be")
    return id_and_text(docs, id_col, text_col).mapInArrow(
        _coded(spark.sparkContext.broadcast(ranks), pattern),
        "doc_id long, n_tokens long, ids binary, decoded binary")
