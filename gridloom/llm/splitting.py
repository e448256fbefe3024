"""Splitting oversized texts at natural boundaries with overlap (problem 8).

The tokenizer gives the character span of each token and, as one letter for each
token, how strong a boundary the place after it is: ``p`` paragraph, ``l`` line,
``s`` sentence, ``c`` clause, ``w`` word, ``x`` within a word, ``m`` within a character.
On that string of letters, a regular expression with bounded quantifiers
takes piece after piece: its alternatives are ordered by strength, first within
the second half of the room, then anywhere in it, and it falls back to a place
between two characters. SQL array functions turn the lengths
into token positions, with a lookback of up to ``overlap`` tokens that is shortened
where it would begin within a character, and cut the text.

Sizes are those of the tokens of the whole text: a piece is a run of them, of
at most ``limit``, and begins with the last ``overlap`` tokens of the one before.

Defined results for odd input: null and empty texts and those of at most ``limit`` tokens
give no pieces; a run of tokens within one character that exceeds the room is cut
after the last token of the room; repeated rows are split each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.tokens import RANKS, _text_spans, byte_level, has_ranks, load, load_ranks, tokenizer_path

LIMIT, OVERLAP = 1024, 64
LETTERS = "plscw"

_CLAUSE, _SENTENCE, _CLOSERS = ",;:،؛–—", ".!?…؟", "\"'”’»)]"
_WIDE_CLAUSE, _WIDE_SENTENCE, _WIDE_CLOSERS = "，；、：", "。！？", "”’」』）"
_SPACES = np.array([chr(c).isspace() for c in range(0x3001)])
_RANKS = np.frombuffer(b"xwcslp", dtype=np.uint8)


def _among(codes: np.ndarray, characters: str) -> np.ndarray:
    return np.isin(codes, np.array([ord(c) for c in characters], dtype=codes.dtype))


def break_ranks(text: str) -> np.ndarray:
    """For each place of the text (0 before the first character) the strength of the break there, 0 for none.

    A break lies before the white space that makes it: the tokenizer begins a word with
    the blank before it, so a piece that ends there has the same tokens on its own.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(codes)
    ranks = np.zeros(n + 1, dtype=np.uint8)
    space = _SPACES[np.minimum(codes, 0x3000)] & (codes <= 0x3000)
    start = np.flatnonzero(space & ~np.r_[False, space[:-1]])
    end = np.flatnonzero(space & ~np.r_[space[1:], False]) + 1
    feeds = np.r_[0, np.cumsum(codes == 10)]
    lines = np.r_[0, np.cumsum(_among(codes, "\n\r\u2028"))]
    paragraphs = np.r_[0, np.cumsum(codes == 0x2029)]
    before = start - 1
    for _ in range(3):  # marks that close a quotation or a bracket
        before = np.where((before > 0) & _among(codes[before], _CLOSERS), before - 1, before)
    found = np.ones(len(start), dtype=np.uint8)
    known = before >= 0
    found[known & _among(codes[before], _CLAUSE)] = 2
    found[known & _among(codes[before], _SENTENCE)] = 3
    found[lines[end] > lines[start]] = 4
    found[(feeds[end] - feeds[start] > 1) | (paragraphs[end] > paragraphs[start])] = 5
    ranks[start] = found
    # scripts without blanks: a break follows the mark itself
    for marks, rank in ((_WIDE_CLAUSE, 2), (_WIDE_SENTENCE, 3)):
        at = np.flatnonzero(_among(codes, marks)) + 1
        for _ in range(2):
            at = np.where((at < n) & _among(codes[np.minimum(at, n - 1)], _WIDE_CLOSERS), at + 1, at)
        ranks[at] = np.maximum(ranks[at], rank)
    return ranks


def byte_spans(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(first byte, byte after, first character, character after)`` of the whole characters that each token touches, from the bytes that each id stands for."""
    ends = np.cumsum(lengths[ids])
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    is_first = (data & 0xC0) != 0x80
    begun = np.cumsum(is_first)  # characters begun with each byte
    first, after = begun[ends - lengths[ids]] - 1, begun[ends - 1]
    places = np.r_[np.flatnonzero(is_first), len(data)]
    return places[first], places[after], first, after


def character_spans(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`byte_spans`, from the characters that each token touches."""
    at = np.array(spans, dtype=np.int64).reshape(-1, 2)
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    before = np.r_[0, np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF).astype(np.int64))]
    return before[at[:, 0]], before[at[:, 1]], at[:, 0], at[:, 1]


def boundary_letters(text: str, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The letter of the place after each token, from the characters it touches."""
    letters = _RANKS[break_ranks(text)[ends]].copy()
    # the next token begins before this one ends: both lie in the same character
    letters[:-1][starts[1:] < ends[:-1]] = ord("m")
    return letters.tobytes()


def _encoded(path: str, texts: list[str], limit: int) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """Place and spans of the texts of more than ``limit`` tokens."""
    # where a token has one byte at least, shorter texts have no more tokens
    at = [i for i, t in enumerate(texts) if t and (not byte_level(path) or (len(t) * 4 > limit and len(t.encode()) > limit))]
    if has_ranks(path):
        encoding, lengths = load_ranks(path)
        for i in at:
            ids = encoding.encode_to_numpy(texts[i], disallowed_special=())
            if len(ids) > limit:
                yield i, byte_spans(texts[i], ids, lengths)
    elif at:
        for i, e in zip(at, load(path).encode_batch([texts[i] for i in at], add_special_tokens=False), strict=True):
            if len(e) > limit:
                yield i, character_spans(texts[i], e.offsets)


def _long_texts(path: str, limit: int, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(column)
            for start, end in _text_spans(texts):
                part = texts.slice(start, end - start).to_pylist()
                rows, letters, spans = [], [], []
                for i, found in _encoded(path, part, limit):
                    rows.append(start + i)
                    letters.append(boundary_letters(part[i], found[2], found[3]).decode())
                    spans.append(found)
                if rows:
                    offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in letters])], pa.int32())
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([s[k] for s in spans]), pa.int32())) for k in range(4)]
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in range(column + 1)], pa.array(letters), *lists], names=[*b.schema.names[:column], "text", "letters", *_SPANS])

    return run


_SPANS = ("first_byte", "byte_after", "first_char", "char_after")
#: Pieces whose running sums are taken together.
BLOCK = 128


def _running(lengths: str) -> str:
    """Running sums of an array, block by block."""
    add = "(a, n) -> concat(a, array(element_at(a, -1) + n))"
    blocks = f"transform(sequence(0, (size({lengths}) - 1) div {BLOCK}), j -> slice({lengths}, j * {BLOCK} + 1, {BLOCK}))"
    sums = f"transform({blocks}, s -> aggregate(s, 0, (a, n) -> a + n))"
    bases = f"aggregate({sums}, array(0), {add})"
    return f"flatten(zip_with({blocks}, slice({bases}, 1, (size({lengths}) - 1) div {BLOCK} + 1), (s, base) -> slice(aggregate(s, array(base), {add}), 2, size(s))))"


def _alternatives(room: int) -> str:
    """Alternatives by strength: in the second half of the room, then anywhere in it, then between characters, then anywhere."""
    half = max(1, room // 2)
    strong = ["".join(LETTERS[: k + 1]) for k in range(len(LETTERS))]
    tries = [f".{{{half - 1},{room - 1}}}[{x}]" for x in strong] + [f".{{0,{room - 1}}}[{x}]" for x in strong]
    return "|".join([*tries, f".{{0,{room - 1}}}[^m]", f".{{1,{room}}}"])


def split_pattern(limit: int = LIMIT, overlap: int = OVERLAP) -> str:
    """The first piece has the whole limit as room, the following ones leave room for the overlap; a rest that fits is taken whole."""
    later = limit - overlap
    return f"^(?:{_alternatives(limit)})|.{{1,{later}}}$|(?:{_alternatives(later)})"


def split(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = LIMIT, overlap: int = OVERLAP, tokenizer: str = RANKS) -> DataFrame:
    """``keep, piece_no, token_start, token_end, char_start, char_end, overlap, n_tokens, boundary, text``; pieces count from 0.

    All pieces of a text come out of one array expression, cut by byte, so that the work grows with the length of the text.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    rows = df.select(*keep, F.col(text).cast("string").alias("__text"))
    spans = ", ".join(f"{c} array<int>" for c in _SPANS)
    long_ones = rows.mapInArrow(_long_texts(tokenizer_path(tokenizer), limit, len(keep)), f"{kept}, text string, letters string, {spans}")
    lengths = F.transform(F.regexp_extract_all("letters", F.lit(split_pattern(limit, overlap)), F.lit(0)), F.length)
    # the ends of the pieces are the running sums of the lengths
    cut_at = long_ones.withColumn("lengths", lengths).withColumn("cuts", F.expr(_running("lengths"))).withColumn("marks", F.col("letters").cast("binary")).withColumn("data", F.col("text").cast("binary"))
    before = "if(i = 0, 0, cuts[i - 1])"
    wanted = f"greatest(before - {overlap}, 0)"
    # the letters before the wanted start: as many as stand within a character push it on
    inside = "if(wanted = 0, 0, length(regexp_extract(cast(substring(marks, wanted, before - wanted) as string), '^m*', 0)))"
    piece = """named_struct('piece_no', i, 'token_start', t, 'token_end', e, 'char_start', first_char[t], 'char_end', char_after[e - 1], 'overlap', before - t, 'n_tokens', e - t,
        'boundary', cast(substring(marks, e, 1) as string), 'text', cast(substring(data, first_byte[t] + 1, byte_after[e - 1] - first_byte[t]) as string))"""
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    pieces = f"transform(cuts, (e, i) -> {let(before, 'before', let(wanted, 'wanted', let(f'wanted + {inside}', 't', piece)))})"
    return cut_at.select(*keep, F.inline(F.expr(pieces)))
