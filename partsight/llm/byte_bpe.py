"""Byte-level BPE encoding and decoding with tiktoken over a local rank file.

A long text is cut before it is encoded. A cut is *safe* where every match of the pattern ends: in
front of white space that follows a letter or digit, and between a letter and a digit. So the ids
are those of the whole text, while the library never sees more than about ``PIECE_CHARS`` at once.
Where no cut comes in time, and where white space runs so long that the library's pattern would
exhaust its stack, the matches of the pattern are found one by one and each is encoded by its bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from partsight.llm.common import binaries, stepped

PIECE_CHARS = 1 << 18
#: A run of white space that the library's pattern is not given.
LONG_SPACE = 50_000
_SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \t\r\n])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, without special tokens; a task loads it once."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(rank_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in pieces of ``size`` characters, each extended to the next safe cut."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _match_by_match(enc: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of ``text``, each match of the pattern by itself."""
    ids: list[int] = []
    for m in regex.finditer(enc._pat_str, text):
        ids += enc._encode_single_piece(m[0])
    return ids


def encode_text(enc: tiktoken.Encoding, text: str | None, size: int = PIECE_CHARS) -> np.ndarray:
    if not text:
        return np.empty(0, np.int32)
    if len(text) <= min(size, LONG_SPACE):
        return np.array(enc.encode_ordinary(text), np.int32)
    parts = []
    for piece in safe_pieces(text, size):
        alone = len(piece) > 2 * size or regex.search(r"\s{%d}" % LONG_SPACE, piece)
        parts.append(np.array(_match_by_match(enc, piece) if alone else enc.encode_ordinary(piece), np.int32))
    return np.concatenate(parts)


def encode(
    docs: DataFrame, rank_file: str, pattern: str, text: str = "text", into: str = "ids", decoded: str | None = None, keep_text: bool = True
) -> DataFrame:
    """Adds ``into`` (array<int>), the token ids of the whole ``text``; ``decoded`` names a column for their bytes.

    Null and empty texts give an empty array. Rows are independent: no shuffle, repeated rows stay.
    An input column that is already called ``into`` or ``decoded`` is replaced.
    """
    kept = [f for f in docs.schema.fields if f.name not in (into, decoded) and (keep_text or f.name != text)]
    added = [T.StructField(into, T.ArrayType(T.IntegerType()))]
    added += [T.StructField(decoded, T.BinaryType())] if decoded else []
    schema = T.StructType([*kept, *added])

    def step(batches):
        enc = encoding(rank_file, pattern)
        for batch in stepped(batches, text):
            ids = [encode_text(enc, s) for s in batch.column(text).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            arrays = [*(batch.column(f.name) for f in kept), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))]
            if decoded:
                arrays.append(binaries([enc.decode_bytes(x.tolist()) for x in ids]))
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return docs.mapInArrow(step, schema)


def decode(encoded: DataFrame, rank_file: str, pattern: str, ids: str = "ids", into: str = "raw") -> DataFrame:
    """Adds ``into`` (binary), the raw bytes of the token ids; null ids give null."""
    kept = [f for f in encoded.schema.fields if f.name != into]
    schema = T.StructType([*kept, T.StructField(into, T.BinaryType())])

    def step(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            column = batch.column(ids)
            raw = []
            for i in range(batch.num_rows):
                row = column[i]
                raw.append(enc.decode_bytes(row.values.to_numpy().tolist()) if row.is_valid else None)
            arrays = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*arrays, binaries(raw)], [*(f.name for f in kept), into])

    return encoded.mapInArrow(step, schema)
