"""Encoding of a corpus with a public tokenizer, and back (problem 6).

The byte-level tokenizers show each byte of a text as one printable character; the
table is the rule of :func:`byte_characters`. Texts go through the tokenizers
library in Arrow batches, cut into groups of bounded size; ids come out
as lists, on demand with the character span of each token. Decoding reverses the table:
the tokens' characters become bytes again, which are joined before they are
read as UTF-8, so a character that is split over tokens comes back whole.

Defined results for odd input: an empty text gives ``empty_ids`` and a null text
``null_ids``, both the empty list unless stated; strings of special tokens in a
text are ordinary text; a text of blanks has the ids of its blanks; ids that the
vocabulary lacks decode to nothing, bytes that are no UTF-8 to the replacement
character; null ids give a null text. Repeated rows and other columns stay as they are.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
#: The same vocabulary as ranks of byte strings: the same ids at a quarter of the time, for sizes and spans.
RANKS = "byte_bpe_50k.tiktoken"
#: Characters of text that are encoded together, and texts at most.
GROUP_CHARS, GROUP_TEXTS = 200_000, 256


def tokenizer_path(name: str = TOKENIZER) -> str:
    """A path as it is, or the file of that name among the public tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@cache
def load_ranks(path: str):
    """``(encoding, bytes of each id)`` of a vocabulary of ranks, without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def has_ranks(path: str) -> bool:
    return path.endswith(".tiktoken")


@cache
def byte_level(path: str) -> bool:
    """Whether every token stands for one byte of the text at least."""
    if has_ranks(path):
        return True
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    return model.get("normalizer") is None and (model.get("pre_tokenizer") or {}).get("type") == "ByteLevel"


def byte_characters() -> dict[int, str]:
    """The printable character of each byte: itself where it is printable Latin-1, else the next from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(plain))
    return table


@cache
def token_bytes(path: str) -> dict[int, bytes]:
    """Bytes of each id of a byte-level vocabulary, special tokens as their text."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    back = {c: b for b, c in byte_characters().items()}
    special = {t["id"]: t["content"].encode() for t in model.get("added_tokens", [])}
    held = {i: bytes(back[c] for c in text) for text, i in model["model"]["vocab"].items() if all(c in back for c in text)}
    return held | special


def decode(ids: list[int] | None, path: str) -> str | None:
    if ids is None:
        return None
    table = token_bytes(path)
    return b"".join(table.get(i, b"") for i in ids).decode("utf-8", "replace")


def _ids(path: str, empty_ids: tuple[int, ...], null_ids: tuple[int, ...], column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for b in batches:
            names = [*b.schema.names[:column], "ids"]
            texts = b.column(column)
            for start, end in _text_spans(texts):
                part = texts.slice(start, end - start).to_pylist()
                real = [t for t in part if t]
                encoded = iter(tokenizer.encode_batch_fast(real, add_special_tokens=False) if real else ())
                ids = [list(null_ids) if t is None else next(encoded).ids if t else list(empty_ids) for t in part]
                yield pa.RecordBatch.from_arrays([*[b.column(i).slice(start, end - start) for i in range(column)], pa.array(ids, pa.list_(pa.int32()))], names=names)

    return run


def _text_spans(texts: pa.Array) -> Iterator[tuple[int, int]]:
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        held += int(n)
        if held >= GROUP_CHARS or i + 1 - start >= GROUP_TEXTS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizer: str = TOKENIZER, empty_ids: tuple[int, ...] = (), null_ids: tuple[int, ...] = ()) -> DataFrame:
    """Columns ``keep`` and ``ids array<int>`` of each text. No shuffle; one pass over the texts."""
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    rows = df.select(*keep, F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(_ids(tokenizer_path(tokenizer), empty_ids, null_ids, len(keep)), f"{kept}, ids array<int>")


def token_counts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizer: str = RANKS) -> DataFrame:
    """Columns ``keep`` and ``tokens int`` of each text; null and empty texts have none."""
    path, column = tokenizer_path(tokenizer), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if has_ranks(path):
            encoding, _ = load_ranks(path)
            for b in batches:
                counts = np.fromiter((len(encoding.encode_to_numpy(t, disallowed_special=())) if t else 0 for t in (x.as_py() for x in b.column(column))), np.int32, b.num_rows)
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(column)], pa.array(counts)], names=[*b.schema.names[:column], "tokens"])
            return
        model = load(path)
        for b in batches:
            texts = b.column(column)
            counts = np.zeros(b.num_rows, dtype=np.int32)
            for start, end in _text_spans(texts):
                part = texts.slice(start, end - start).to_pylist()
                at = [i for i, t in enumerate(part) if t]
                if at:
                    counts[[start + i for i in at]] = [len(e) for e in model.encode_batch_fast([part[i] for i in at], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(column)], pa.array(counts)], names=[*b.schema.names[:column], "tokens"])

    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"{kept}, tokens int")


def encode_spans(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizer: str = TOKENIZER) -> DataFrame:
    """Columns ``keep``, ``ids``, ``starts`` and ``ends``: the characters of the text that each token touches."""
    path, column = tokenizer_path(tokenizer), len(keep)
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in batches:
            for start, end in _text_spans(b.column(column)):
                part = [t or "" for t in b.column(column).slice(start, end - start).to_pylist()]
                encoded = model.encode_batch(part, add_special_tokens=False)
                spans = [e.offsets for e in encoded]
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(i).slice(start, end - start) for i in range(column)], pa.array([e.ids for e in encoded], ints), pa.array([[s for s, _ in x] for x in spans], ints), pa.array([[e for _, e in x] for x in spans], ints)],
                    names=[*b.schema.names[:column], "ids", "starts", "ends"],
                )

    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"{kept}, ids array<int>, starts array<int>, ends array<int>")


def decode_ids(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), tokenizer: str = TOKENIZER) -> DataFrame:
    """Columns ``keep`` and ``text`` of each list of ids."""
    path, column = tokenizer_path(tokenizer), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, end in ((k, min(k + GROUP_TEXTS, b.num_rows)) for k in range(0, b.num_rows, GROUP_TEXTS)):
                texts = [decode(x, path) for x in b.column(column).slice(start, end - start).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[b.column(i).slice(start, end - start) for i in range(column)], pa.array(texts, pa.string())], names=[*b.schema.names[:column], "text"])

    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(ids).cast("array<int>").alias("__ids")).mapInArrow(run, f"{kept}, text string")
