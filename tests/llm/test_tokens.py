import pytest

from gridloom.llm import tokens
from gridloom.llm.queries import QUERIES

PATH = tokens.tokenizer_path()
TEXTS = [
    None, "", " ", "\n\n  \t", "a", "<|endoftext|> is ordinary", "naïve – Ελληνικά 漢字 🏴‍☠️👩‍👩‍👧 ​\u0000  é", "x" * 20_000, "word " * 30_000, "漢" * 3000, "\r\n\r\n", "🙂" * 500, "﻿bom", "Ġ Ċ ¡ÿ",
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "doc_id as ids", "text as __text")


def test_table_of_bytes():
    table = tokens.byte_characters()
    assert len(table) == 256 == len(set(table.values())) and table[32] == "Ġ" and table[10] == "Ċ" and table[65] == "A"
    assert len(tokens.token_bytes(PATH)) == 50_257


def test_ids_and_round_trip(spark):
    df = frame(spark, TEXTS)
    encoded = tokens.encode(df)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    reference = tokens.load(PATH)
    for i, text in enumerate(TEXTS):
        assert got[i] == (reference.encode(text, add_special_tokens=False).ids if text else [])
    back = {r.doc_id: r.text for r in tokens.decode_ids(encoded).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.tokens for r in tokens.token_counts(df).collect()} == {k: len(v) for k, v in got.items()}


def test_same_ids_as_the_other_library():
    import base64

    import public_tokenizers as public
    import tiktoken

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in TEXTS:
        if text:
            assert tokens.load(PATH).encode(text, add_special_tokens=False).ids == other.encode_ordinary(text)


def test_stated_ids_and_repeats(spark):
    df = frame(spark, [None, "", "a"])
    rows = tokens.encode(df.unionByName(df), empty_ids=(7,), null_ids=(8, 9)).collect()
    assert sorted((r.doc_id, r.ids) for r in rows) == [(0, [8, 9])] * 2 + [(1, [7])] * 2 + [(2, [64])] * 2
    assert tokens.encode(df.where("false")).count() == 0


def test_spans_cover_the_text(spark):
    for r in tokens.encode_spans(frame(spark, TEXTS)).collect():
        text = TEXTS[r.doc_id] or ""
        assert len(r.ids) == len(r.starts) == len(r.ends)
        assert not text or (r.starts[0] == 0 and r.ends[-1] == len(text) and all(b <= e for b, e in zip(r.starts[1:], r.ends, strict=False)))


def test_decoding_odd_ids():
    assert tokens.decode(None, PATH) is None and tokens.decode([10**6], PATH) == ""
    half = tokens.load(PATH).encode("漢", add_special_tokens=False).ids[:-1]
    assert tokens.decode(half, PATH) == "�"


@pytest.mark.parametrize("query", ["p6_ids"])
def test_whole_table(spark, small, query):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES[query](spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tokens.decode(r.ids, PATH) == (docs[r.doc_id] or "")
