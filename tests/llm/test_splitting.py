import pytest

from gridloom.llm import splitting, tokens
from gridloom.llm.queries import QUERIES

PATH = tokens.tokenizer_path()


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "doc_id as letters", "text as cuts")


def check(rows, text, limit, overlap):
    e = tokens.load(PATH).encode(text, add_special_tokens=False)
    n, spans = len(e), e.offsets
    inside = [False, *(spans[i][0] < spans[i - 1][1] for i in range(1, n)), False]
    rows.sort(key=lambda r: r.piece_no)
    assert [r.piece_no for r in rows] == list(range(len(rows))) and len(rows) >= 2
    assert rows[0].token_start == 0 and rows[-1].token_end == n
    for before, r in zip([None, *rows], rows, strict=False):
        assert 0 < r.n_tokens <= limit and r.n_tokens == r.token_end - r.token_start
        assert r.text == text[spans[r.token_start][0] : spans[r.token_end - 1][1]]
        if before:
            assert r.token_end > before.token_end and r.overlap == before.token_end - r.token_start <= overlap
            assert not inside[r.token_start] or r.token_start == before.token_end
            wanted = max(0, before.token_end - overlap)
            assert all(inside[k] for k in range(wanted, r.token_start))
    assert not any(inside[r.token_end] for r in rows) or len(set(text)) == 1


TEXTS = [
    "One sentence is here. Another, with a clause; follows it! " * 60,
    "First paragraph of some words.\n\nSecond one, longer than that.\nA line. " * 40,
    "word " * 700, "x1y2z3" * 400, "漢字仮名交じり文。" * 120, "🙂🏴‍☠️" * 200, "Ελληνικά κείμενα, χωρίς τέλος· " * 50, "\n" * 3000, " " * 5000,
]


@pytest.mark.parametrize(("limit", "overlap"), [(128, 16), (64, 0), (40, 32)])
def test_pieces(spark, limit, overlap):
    rows = splitting.split(frame(spark, TEXTS), limit=limit, overlap=overlap).collect()
    sizes = {i: len(tokens.load(PATH).encode(t, add_special_tokens=False)) for i, t in enumerate(TEXTS)}
    for i, text in enumerate(TEXTS):
        mine = [r for r in rows if r.doc_id == i]
        assert bool(mine) == (sizes[i] > limit)
        if mine:
            check(mine, text, limit, overlap)


def test_cuts_at_the_strongest_break(spark):
    text = ("Some words go here, and more of them. " * 6).strip() + "\n\n" + ("Other words, and others follow. " * 12).strip()
    first = splitting.split(frame(spark, [text]), limit=100, overlap=8).where("piece_no = 0").first()
    assert first.boundary == "p" and first.text.strip().endswith("more of them.")
    plain = splitting.split(frame(spark, ["alpha beta gamma " * 90]), limit=100, overlap=8).collect()
    assert {r.boundary for r in plain[:-1]} == {"w"}
    sentences = splitting.split(frame(spark, ["Some words go here, and more of them. " * 60]), limit=100, overlap=8).collect()
    assert {r.boundary for r in sentences[:-1]} == {"s"}


def test_texts_that_fit(spark):
    df = frame(spark, [None, "", " ", "short"])
    assert splitting.split(df).count() == 0 and splitting.split(df.where("false")).count() == 0
    twice = frame(spark, [TEXTS[0]])
    assert splitting.split(twice.unionByName(twice), limit=128).count() == 2 * splitting.split(twice, limit=128).count()


def test_long_text(spark):
    text = "The quick brown fox jumps over the lazy dog, again and again. " * 8000
    rows = splitting.split(frame(spark, [text])).collect()
    check(rows, text, 1024, 64)


def test_whole_table(spark, medium):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    want = {k for k, t in docs.items() if t and len(tokens.load(PATH).encode(t, add_special_tokens=False)) > 1024}
    assert {r.doc_id for r in QUERIES["p8_found"](spark, medium).collect()} == want
    rows = {}
    for r in QUERIES["p8_pieces"](spark, medium).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert set(rows) == want
    for k, mine in rows.items():
        check(mine, docs[k], 1024, 64)


def test_spans_of_both_tokenizers_agree(spark, medium):
    df = spark.read.parquet(f"{medium}/documents.parquet")
    columns = ["doc_id", "piece_no", "token_start", "token_end", "char_start", "char_end", "boundary", "text"]
    rows = lambda name: sorted(map(tuple, splitting.split(df, limit=200, overlap=20, tokenizer=name).select(columns).collect()))
    by_ranks = rows(tokens.RANKS)
    assert by_ranks == rows(tokens.TOKENIZER) and len(by_ranks) > 1000


def test_tokens_that_are_no_bytes(spark):
    # a vocabulary that is not byte-level: no shortcut over the number of bytes
    assert not tokens.byte_level(tokens.tokenizer_path("word_bpe_49k.json")) and tokens.byte_level(PATH)
    rows = splitting.split(frame(spark, ["a b c d e f " * 30]), limit=40, overlap=4, tokenizer="word_bpe_49k.json").collect()
    assert max(r.token_end for r in rows) == 180 and all(r.n_tokens <= 40 for r in rows)


def test_a_very_long_text(spark):
    text = "Some words go here, and more of them follow. " * 40_000  # 1.8 million characters
    rows = splitting.split(frame(spark, [text]), limit=64, overlap=8).select("piece_no", "char_start", "char_end", "token_start", "token_end").orderBy("piece_no").collect()
    assert len(rows) > 7000 and rows[-1].char_end == len(text) and all(b.token_start <= a.token_end for a, b in zip(rows, rows[1:]))
