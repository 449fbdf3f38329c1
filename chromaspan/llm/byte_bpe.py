"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before they are encoded, only where the pre-split must have a boundary anyway: before the
space of "letter, space, letter" (ASCII). Left of it a run of letters has just ended, right of it a piece
`` letters`` begins, and neither side looks across. The ids are therefore those of the whole text.

Defined cases: a null text is the empty text without ids; decoding works on raw bytes, so ids that stand for
parts of a character, or for no UTF-8 at all, come back as the bytes they are; unknown ids raise KeyError.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from . import common

SAFE = re.compile("[A-Za-z](?= [A-Za-z])")
#: Characters that are encoded at once.
PIECE_CHARS = 50_000


@functools.lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    begin = 0
    while len(text) - begin > size and (m := SAFE.search(text, begin + size)):
        yield text[begin : m.end()]
        begin = m.end()
    yield text[begin:]


def encode_text(enc, text: str) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    import numpy as np

    return b"".join(np.array(enc.encode_ordinary(p), "<u4").tobytes() for p in safe_parts(text))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids binary: the ids of every whole text, four little-endian bytes each."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoding(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode_text(enc, t) for t in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids"])

    return common.whole_texts(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, raw binary: the bytes that the ids stand for. Null ids decode to no bytes."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        enc = encoding(path, pattern)
        for b in batches:
            raw = [enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], names=["doc_id", "ids", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, raw binary")


def sha256_hex(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
