"""Byte-pair encoding against the tokenizers library, and the transducer against a dictionary."""

from __future__ import annotations

import itertools
import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from motifmill.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(PATH)
    tok.no_truncation()
    tok.no_padding()
    return tok


@pytest.fixture(scope="module")
def plain():
    return bpe.Codec(PATH)


def ids_of(codec, text, size=None):
    return np.frombuffer(b"".join(codec.encode([text], size)[0]), "<u4").tolist()


def test_every_letter_is_split_and_merged_as_in_the_library(library, plain):
    letters = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    odd = []
    for at in range(0, len(letters), 64):
        text = "".join(f"a{c}1{c}! {c}\n{c}{c}b" for c in letters[at : at + 64])
        if ids_of(plain, text) != library.encode(text, add_special_tokens=False).ids:
            odd += [c for c in letters[at : at + 64] if ids_of(plain, f"a{c}1{c}! {c}\n{c}{c}b") != library.encode(f"a{c}1{c}! {c}\n{c}{c}b", add_special_tokens=False).ids]
    assert not odd, [hex(ord(c)) for c in odd]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'stremdlv<|endoftext|>é123!?"))), st.integers(1, 9))
def test_any_text(library, plain, text, size):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids_of(plain, text) == want and ids_of(plain, text, size) == want
    assert plain.decode(np.array(want, np.int64)).decode() == library.decode(want, skip_special_tokens=False)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50300), max_size=30))
def test_any_ids_are_decoded(library, plain, ids):
    assert plain.decode(np.array(ids, np.int64)).decode() == library.decode(ids, skip_special_tokens=False)


def test_special_tokens_and_long_words(library, plain):
    pick = random.Random(3)
    texts = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "", " ", "a" * 3000, "".join(pick.choice("etaoin") for _ in range(5000)), "ß" * 700, "😀" * 300, "\n" * 999 + "x"]
    for text in texts:
        assert ids_of(plain, text) == library.encode(text, add_special_tokens=False).ids


def test_transducer_is_minimal_and_exact(tmp_path):
    pick = random.Random(9)
    words = sorted({bytes(pick.choice(b"abc\xff\x00") for _ in range(pick.randint(1, 7))) for _ in range(700)})
    ids = [[i, *range(i % 4)] for i in range(len(words))]
    (tmp_path / "x").write_bytes(bpe.compile_lexicon(words, ids))
    lexicon = bpe.Lexicon(str(tmp_path / "x"))
    asked = [*words, b"", *(bytes(t) for n in range(1, 5) for t in itertools.product(b"abc\xff", repeat=n)), b"abcabcabcabc"]
    place = {w: i for i, w in enumerate(words)}
    assert lexicon.places(asked).tolist() == [place.get(w, -1) for w in asked]
    assert all(lexicon.ids[lexicon.ends[i] : lexicon.ends[i + 1]].tolist() == one for i, one in enumerate(ids))
    # a minimal automaton has one state for each set of endings that words may still take
    rest = {w[:i]: frozenset(v[i:] for v in words if v[:i] == w[:i]) for w in words for i in range(len(w) + 1)}
    assert len(lexicon.final) == len(set(rest.values()))
    (tmp_path / "none").write_bytes(bpe.compile_lexicon([], []))
    assert bpe.Lexicon(str(tmp_path / "none")).places([b"", b"a"]).tolist() == [-1, -1]
    assert bpe.Lexicon(str(tmp_path / "none")).places([]).tolist() == []


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("words", [0, 5, 1 << 16])
def test_round_trip(spark, library, words):
    texts = ["The the  the\n\n", None, "", "été<|endoftext|> they'll", "x" * 90, "the word " * 30_000, "the word", "the word", "a\u0000b", "日本語 テキスト"] + [f"word{i} the" for i in range(50)]
    rows = [(i if i != 3 else None, t, 1, 2) for i, t in enumerate(texts)] + [(6, "the word", 1, 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, word int")
    got = bpe.round_trip(frame, PATH, words=words)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, *digests(library, t))) for i, t, *_ in rows)
    assert bpe.round_trip(frame.limit(0), PATH).count() == 0


def test_long_texts_in_runs(spark, library, monkeypatch):
    text = " ".join(f"word{i % 7919} été" for i in range(400_000)) + "<|endoftext|>" + "\n" * 5000 + "end"
    row = bpe.round_trip(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).first()
    assert tuple(row)[1:] == digests(library, text)


def test_columns_keep_others(spark, library):
    frame = spark.createDataFrame([("Hello there", 1), (None, 2), ("", 3)], "text string, ids int")
    lexicon = bpe.publish_lexicon(frame, PATH)
    coded = frame.withColumn("coded", bpe.encode_column(spark, F.col("text"), PATH, lexicon))
    out = coded.withColumn("back", bpe.decode_column(spark, F.col("coded"), PATH)).orderBy("ids").collect()
    assert [r["coded"] for r in out] == [library.encode("Hello there", add_special_tokens=False).ids, [], []]
    assert [r["back"] for r in out] == ["Hello there", "", ""] and [r["ids"] for r in out] == [1, 2, 3]


def test_counts_cover_all_texts(spark):
    frame = spark.createDataFrame([("the cat, the é1é",), ("cat\n\nthe",), (None,)], "text string").repartition(3)
    assert {bytes(r["word"]).decode(): r["n"] for r in bpe.word_counts(frame).collect()} == {"the": 3, "cat": 2, "é": 2}


def test_frequent_words_are_whole_levels(spark):
    counts = spark.createDataFrame([(f"w{i:03}".encode(), 1 + 300 // (i + 1)) for i in range(300)], "word binary, n long")
    got = bpe.frequent_words(counts, 40)
    assert 20 < len(got) <= 40 and got == [f"w{i:03}".encode() for i in range(len(got))]
    assert bpe.frequent_words(counts, 0) == [] and len(bpe.frequent_words(counts, 300)) == 300
