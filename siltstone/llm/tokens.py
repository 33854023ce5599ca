"""Encoding whole texts with a public byte-level BPE, and back.

The vocabulary file's path is a parameter; nothing is trained and nothing copied. Workers read
the file once each. Texts pass as Arrow batches in slices, so a task holds few texts at a time.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Texts and bytes encoded at a time.
SLICE, SLICE_BYTES = 256, 4_000_000


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a vocabulary file; strings of special tokens are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    return t


def byte_alphabet() -> dict[str, int]:
    """Byte of each character that stands for a byte in the vocabulary.

    Fixed values of the format: printable Latin-1 bytes stand for themselves, the others, in order,
    for the code points from 256.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id; added tokens are their own text."""
    t, table = tokenizer(path), byte_alphabet()
    vocabulary = t.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for word, i in vocabulary.items():
        out[i] = bytes(table[c] for c in word) if all(c in table for c in word) else word.encode()
    return out


def decode(ids: list[int], path: str = VOCABULARY) -> str:
    """The text of ``ids``. A character may be split over ids: bytes are joined first, and what is no character becomes U+FFFD."""
    table = token_bytes(path)
    return b"".join(table[i] for i in ids).decode("utf-8", "replace")


def spans(text: str, ids: list[int], path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, after, split): the characters each id touches, as code points [first, after), and whether it begins inside one.

    Bytes are mapped to characters by counting the bytes that begin one; two ids that share a split
    character both have it in their span.
    """
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    table = token_bytes(path)
    ends = np.cumsum([len(table[i]) for i in ids], dtype=np.int64) if len(ids) else np.zeros(0, np.int64)
    begins = np.r_[0, ends[:-1]] if len(ids) else ends
    lead = (raw & 0xC0) != 0x80
    upto = np.r_[0, np.cumsum(lead)]
    return upto[np.minimum(begins + 1, len(raw))] - 1, upto[ends], ~lead[begins] if len(ids) else np.zeros(0, bool)


def _texts(column: pa.Array) -> list[str]:
    try:
        return column.fill_null("").to_pylist()
    except UnicodeDecodeError:  # bytes that are no UTF-8
        return [(b or b"").decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def _encoded(column: pa.Array, path: str) -> Iterator[tuple[int, list[str], list]]:
    """(first row, texts, encodings) of slices of a column, by number and by size, so that few long texts are held at a time."""
    t = tokenizer(path)
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        after = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES))
        after = min(max(after, at + 1), at + SLICE, len(column))
        texts = _texts(column.slice(at, after - at))
        yield at, texts, t.encode_batch_fast(texts, add_special_tokens=False)
        at = after


def encode(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of each row's whole text; one row for each row given.

    Null and empty texts give an empty list. Other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts, found in _encoded(batch["t"], path):
                lists = [e.ids for e in found]
                offsets = np.cumsum([0, *map(len, lists)], dtype=np.int32)
                flat = np.concatenate([np.zeros(0, np.int32), *(np.array(ids, np.int32) for ids in lists)])
                yield pa.RecordBatch.from_arrays([batch["i"].slice(at, len(texts)), pa.ListArray.from_arrays(offsets, flat)], names=[id_column, "ids"])

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.selectExpr(f"`{id_column}` as i", f"`{text_column}` as t").mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def sizes(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens) of each row; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts, found in _encoded(batch["t"], path):
                yield pa.RecordBatch.from_arrays([batch["i"].slice(at, len(texts)), pa.array([len(e) for e in found], pa.int64())], names=[id_column, "n_tokens"])

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.selectExpr(f"`{id_column}` as i", f"`{text_column}` as t").mapInArrow(run, f"`{id_column}` {kind}, n_tokens bigint")


def round_trip(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens, n_split, same): ids, those that begin inside a character, and whether decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts, found in _encoded(batch["t"], path):
                split = [int(spans(t, e.ids, path)[2].sum()) for t, e in zip(texts, found)]
                same = [decode(e.ids, path) == t for t, e in zip(texts, found)]
                columns = [batch["i"].slice(at, len(texts)), pa.array([len(e) for e in found], pa.int64()), pa.array(split, pa.int64()), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_column, "n_tokens", "n_split", "same"])

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.selectExpr(f"`{id_column}` as i", f"`{text_column}` as t").mapInArrow(run, f"`{id_column}` {kind}, n_tokens bigint, n_split bigint, same boolean")


def offsets(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, first, after, split): of each row's token ids, in their order, the code points [first, after) that each touches and whether it begins inside a character.

    Null and empty texts have empty lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts, found in _encoded(batch["t"], path):
                parts = [spans(t, e.ids, path) for t, e in zip(texts, found)]
                edges = np.cumsum([0, *(len(p[0]) for p in parts)], dtype=np.int32)
                lists = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate([np.zeros(0, k), *(p[i].astype(k) for p in parts)]))) for i, k in enumerate((np.int32, np.int32, bool))]
                yield pa.RecordBatch.from_arrays([batch["i"].slice(at, len(texts)), *lists], names=[id_column, "first", "after", "split"])

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.selectExpr(f"`{id_column}` as i", f"`{text_column}` as t").mapInArrow(run, f"`{id_column}` {kind}, first array<int>, after array<int>, split array<boolean>")


def vocabulary_exists(path: str = VOCABULARY) -> bool:
    return Path(path).exists()
