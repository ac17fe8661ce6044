import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gaugeflow.llm import tokens

PATH = public_tokenizers.path(tokens.VOCABULARY_FILE)
ODD = [
    None,
    "",
    "<|endoftext|>",
    "a<|endoftext|> b<|endoftext|><|endoftext|>x <|endoftext|",
    "  \n\n x  y\t\tz   ",
    "it's IT'S we'll they're 'x ''s",
    "\x1c\x1d a b　c\x85d e\xa0 f",
    "漢字テスト 123٣٤ ½²",
    "é zà​",
    "x" * 5_000,
    " " * 3_000 + "a",
    "\x00\x01�",
    "🙂🙃 👍🏽",
    "౜ a౜1՘",
    "repeated words " * 3,
    "repeated words " * 3,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    tokenizer = tokens.checked_tokenizer(open(PATH, encoding="utf-8").read())
    return tokens.TokenCounter(tokenizer, tokens.whole_tokens(tokenizer))


def lengths(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_whole_texts_count_as_the_library_has_it(counter, library):
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()] + ODD
    assert [counter(t or "") for t in texts] == lengths(library, texts)


def test_most_of_the_vocabulary_is_proven(counter):
    assert len(counter.whole) > 49_000
    assert "<|endoftext|>" not in counter.whole


def test_characters_that_engines_class_differently_are_found(counter, library):
    chars = [chr(c) for c in (*range(0x3000), *range(0x1F000, 0x1F100)) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"{c} a{c}1{c}!{c} {c}{c}\n{c}" for c in chars]
    assert [counter(t) for t in texts] == lengths(library, texts)
    assert counter.odd and counter.same


def test_long_texts_are_cut_where_no_token_crosses(counter, library, monkeypatch):
    monkeypatch.setattr(tokens, "PIECE", 40)
    texts = ["some words  and\n\nmore   of them, it's 12 345 x　y " * 30, "nospaces" * 50, " " * 500, "a  b" * 100]
    assert [counter(t) for t in texts] == lengths(library, texts)


def test_forgetting_merged_strings_changes_nothing(counter, library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    text = " ".join(f"zqx{i}vw" for i in range(50)) * 2
    assert counter(text) == lengths(library, [text])[0]


def test_rows_of_a_table(spark, library):
    rows = [(i, t, "n", -1) for i, t in enumerate(ODD)] + [(None, "x y", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, row int")
    out = tokens.count_tokens(docs, PATH, limit=3)
    assert out.columns == ["doc_id", "text", "row", "n_bytes", "n_tokens", "over_limit"]
    found = sorted(out.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect(), key=lambda r: (r[0] is None, r[0]))
    counts = lengths(library, [r[1] for r in rows])
    assert [tuple(r) for r in found] == [(r[0], len((r[1] or "").encode()), n, n > 3) for r, n in zip(rows, counts)]
    assert tokens.count_tokens(docs.limit(0), PATH).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tokens.checked_tokenizer(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
