"""Prefix dynamic programming against the tiktoken library."""

import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from countloom.llm import prefix_bpe, queries

SF = "/root/testdata/sf0.001"
PATH = P.path("byte_bpe_multi_50k.tiktoken")
#: Blanks, digits and letters of many kinds; two of a newer Unicode than tiktoken's; an astral one.
ALPHABET = [" ", "\n", "\t", "a", "b", "é", "的", "1", "२", "'", "s", "!", "՘", "\U00011de0", "　", "\x1c", "\x85", "\x00", "日本", "the", "ing", " \r\n", "ſ", "😀", "<|endoftext|>"]


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=prefix_bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return prefix_bpe.codec(PATH)


def test_query(spark, theirs):
    want = {}
    for d, text in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall():
        ids = theirs.encode_ordinary(text or "")
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(theirs.decode_bytes(ids)).hexdigest())
    got = queries.QUERIES["op11_prefix_bpe"](spark, SF).collect()
    assert len(got) == len(want) and {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want


def test_edits(codec, theirs):
    rnd = random.Random(1)
    for _ in range(3000):
        text, new = ("".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(n))) for n in (40, 6))
        last, starts = codec.state(text)
        assert codec.walk(last) == theirs.encode_ordinary(text) == np.frombuffer(codec.encode([text])[0], "<i4").tolist()
        a = rnd.randrange(len(text) + 1)
        b = rnd.randrange(a, len(text) + 1)
        out, *state, _ = codec.edit(text, last, starts, a, b, new)
        assert out == text[:a] + new + text[b:] and tuple(state) == codec.state(out)


def test_one_long_piece(codec, theirs):
    rnd = random.Random(2)
    text = "".join(rnd.choice("abcdetin") for _ in range(100_000))
    last, starts = codec.state(text)
    assert codec.walk(last) == theirs.encode_ordinary(text)
    for a, b, new in ((50_000, 50_003, "qq"), (100_000, 100_000, "the"), (0, 1, "")):
        out, *state, made = codec.edit(text, last, starts, a, b, new)
        assert tuple(state) == codec.state(out) and made < 200


def test_slices(codec, theirs, monkeypatch):
    monkeypatch.setattr(prefix_bpe, "SLICE", 7)
    rnd = random.Random(3)
    for _ in range(500):
        text = "".join(rnd.choice(ALPHABET) for _ in range(60))
        assert np.frombuffer(codec.encode([text])[0], "<i4").tolist() == theirs.encode_ordinary(text)


def test_forgotten_pieces(theirs, monkeypatch):
    monkeypatch.setattr(prefix_bpe, "PIECES", 3)
    c = prefix_bpe.PrefixCodec(PATH)
    for text in ("a few words", "and a few more words", "a few", "words again"):
        assert np.frombuffer(c.encode([text, None])[0], "<i4").tolist() == theirs.encode_ordinary(text)


def test_columns(spark, theirs):
    rows = [(1, "now", "x", b"y", 3, 4, "!"), (1, "now", "x", b"y", 3, 4, "!"), (2, None, "x", b"y", None, 1, None), (3, "", "x", b"y", -5, 99, "é new"), (None, " a  b", "x", b"y", 1, 3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded binary, a int, b int, new string")
    coded = prefix_bpe.encode(df, PATH)
    assert sorted(coded.columns) == sorted(df.columns)
    back = prefix_bpe.decode(coded, PATH).collect()
    assert [bytes(r["decoded"]).decode() for r in back] == [r[1] or "" for r in rows] and [r["ids"] for r in back] == [theirs.encode_ordinary(r[1] or "") for r in rows]
    edited = prefix_bpe.edit(prefix_bpe.prefixes(df, PATH), PATH, start_col="a", end_col="b", new_col="new").collect()
    want = ["now!", "now!", "", "é new", "  b"]
    assert [r["text"] for r in edited] == want and [r["ids"] for r in edited] == [theirs.encode_ordinary(x) for x in want]
    assert [r["text"] for r in prefix_bpe.edit(prefix_bpe.prefixes(df, PATH), PATH, new_col="new").collect()] == ["now!", "now!", "", "é new", " a  b"]
    for f in (prefix_bpe.encode, prefix_bpe.prefixes):
        assert f(df.limit(0), PATH).count() == 0


def test_other_vocabularies_raise(tmp_path):
    import base64

    for tokens in ([b"ab"], [bytes([b]) for b in range(256)] + [b"abc"]):
        (tmp_path / "v").write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
        with pytest.raises(ValueError):
            prefix_bpe.PrefixCodec(str(tmp_path / "v")).encode(["abcd"])
