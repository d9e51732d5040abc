import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from motifmill.llm import common, packing, quality_classifier, sentencepieces

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def packed(df, **options):
    tok, rows = Tokenizer.from_file(WORDS), df.select("doc_id", "text").collect()
    out = packing.pack(df, WORDS, **options).collect()
    by_doc = {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc in rows:
        ids = np.array([*tok.encode(doc["text"] or "", add_special_tokens=False).ids, 1], np.uint32)
        for p in by_doc[doc["doc_id"]]:
            assert p["doc_tokens"] == len(ids) and p["length"] > 0 and p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].astype("<u4").tobytes())
    window = options.get("window", packing.WINDOW)
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    return rows, out, sequences


def test_packing(documents):
    rows, out, sequences = packed(documents)
    assert sum(r["length"] for r in out) == sum({r["doc_id"]: r["doc_tokens"] for r in out}.values())
    assert sum(sum(r["length"] for r in own) < packing.WINDOW for own in sequences.values()) <= 1 and set(sequences) == set(range(len(sequences)))


def test_packing_odd(odd, spark):
    rows, out, _ = packed(odd.where("doc_id is not null"), bucket_rows=3)
    assert len([r for r in out if r["doc_id"] == 4]) == 2
    assert packing.pack(odd.where("false"), WORDS).count() == 0
    same = spark.createDataFrame([(i, "a common length of text") for i in range(300)], "doc_id long, text string")
    _, out, sequences = packed(same, window=64, bucket_rows=40)
    assert sum(sum(r["length"] for r in own) < 64 for own in sequences.values()) <= 1


def test_plan_uses_no_more_than_there_is():
    r = np.random.default_rng(1)
    h = r.integers(0, 9, 64)
    h[0] = 0
    plan = packing.make_plan(h, 64)
    length = np.repeat(np.arange(64), h)
    index = np.concatenate([np.arange(n) for n in h])
    seq, offset = plan.place(length, index)
    fill = np.bincount(seq[seq >= 0], length[seq >= 0])
    assert (fill == 64).all() and len(fill) == plan.sequences and (seq >= 0).mean() > 0.8
    assert len({(s, o) for s, o in zip(seq, offset, strict=True) if s >= 0}) == (seq >= 0).sum()
    assert packing.make_plan(np.zeros(64, int), 64).place(np.array([3]), np.array([0]))[0][0] == -1


def test_driver_holds_little_while_it_plans(documents):
    """Neither all pairs of lengths, nor a list of all combinations, nor a tokenizer."""
    h = np.random.default_rng(1).integers(1, 60, packing.WINDOW)
    h[0] = 0
    tracemalloc.start()
    plan = packing.make_plan(h, packing.WINDOW)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert plan.sequences > 0.7 * (h * np.arange(packing.WINDOW)).sum() / packing.WINDOW and most < 60e6
    common.forget_kept()
    assert packing.pack(documents, WORDS).count() > 0 and not common._KEPT


def test_combinations_are_all_there_in_order():
    r = np.random.default_rng(5)
    for window in (1, 2, 3, 4, 9, 10, 33):
        present = np.concatenate([[True], r.random(window - 1) < 0.8])
        pairs = [(a, window - a, 0) for a in range(1, window) if a >= window - a]
        triples = [(a, b, window - a - b) for a in range(1, window) for b in range(1, a + 1) if 0 < window - a - b <= b]
        assert [tuple(c) for c in packing.combinations(window, present).tolist()] == [c for c in pairs + triples if all(present[y] for y in c)]


def test_least_squares_lowers_the_error():
    h = np.random.default_rng(2).integers(0, 50, 40).astype(float)
    h[0] = 0
    combos = packing.combinations(40, np.ones(40, bool))
    error = lambda x: ((sum(np.bincount(combos[:, i], x, 40) for i in range(3)) * (np.arange(40) > 0) - h) ** 2).sum()
    assert error(packing.least_squares(combos, h, 100)) < error(packing.least_squares(combos, h, 10)) < (h**2).sum() and (combos.sum(1) == 40).all()


@pytest.fixture(scope="module")
def coder():
    return sentencepieces.PieceCoder(PIECES)


def test_pieces_equal_the_library(coder, documents, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [r["text"] or "" for df in (documents, odd) for r in df.select("text").collect()]
    r = random.Random(1)
    letters = ["a", "b", "e", "th", "ing", "er", " ", "  ", "\n", "\t", "é", "日", "本", "👍", "▁", ".", ",", "http", "://", "0", "12", "́", "x" * 5]
    texts += ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(500)] + ["".join(r.choice("abcdetshing") for _ in range(20_000)), " " * 5000, "日" * 300]
    for t in texts:
        ids = coder.encode(t)
        assert ids.tolist() == sp.encode(t)
        assert coder.decode(ids).decode() == t.replace("▁", " ")


def test_pieces_over_frames(spark, odd):
    encoded = sentencepieces.encode(odd, PIECES)
    back = {r["doc_id"]: r["text"] for r in sentencepieces.decode(encoded, PIECES).collect()}
    assert all(back[r["doc_id"]] == (r["text"] or "").replace("▁", " ") for r in odd.collect())
    out = sentencepieces.round_trip(odd, PIECES).collect()
    assert len(out) == odd.count() and {r["doc_id"] for r in out if not r["same_text"]} == {7}
    assert sentencepieces.round_trip(odd.where("false"), PIECES).count() == 0


def test_words_have_the_ids_of_the_library():
    """Letters and the marks after them are encoded apart, each distinct word once."""
    tok, coder = Tokenizer.from_file(WORDS), packing.WordTokenizer(WORDS)
    assert coder.bare is not None
    r = random.Random(3)
    parts = ["a", "the", "ing", "s", "t", "ll", "'", "'s", "''", ".", ",", "%%%", "|", "-", "<|", "<|endoftext|>", "7", "20", "A", "É", "ß", "é", "÷", "ÿ", "à", "µ", "ª", "é", "ñ", "日本", "İ", "ſ", "\x1c", "\x85", "\xa0", " "]
    words = [bytes([97 + i]).decode() for i in range(26)] + [chr(c) for c in range(0xA1, 0x180)] + [chr(c) + "." for c in range(0xDF, 0x100)]
    words += ["".join(r.choice(parts) for _ in range(r.randrange(1, 7))) for _ in range(20_000)]
    texts = ["".join(w + r.choice(" \t\n\v\f\r") * r.randrange(1, 3) for w in words[at : at + 40]) for at in range(0, len(words), 40)] + ["", " ", "\n a"]
    for some in (texts, texts[::-1], []):
        assert [x.tolist() for x in coder.encode([t.encode() for t in some])] == [tok.encode(t, add_special_tokens=False).ids for t in some]


def test_memo_of_words_turns_over(monkeypatch):
    monkeypatch.setattr(packing, "TOKEN_MEMO", 50)
    tok, coder = Tokenizer.from_file(WORDS), packing.WordTokenizer(WORDS)
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abcé") for _ in range(r.randrange(1, 4))) + r.choice(["", ".", "!?"]) for _ in range(30)) for _ in range(40)]
    assert [x.tolist() for t in texts for x in coder.encode([t.encode()])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_worker_keeps_one_memo_at_a_time():
    """Memos of stages that the same workers serve one after the other don't add up."""
    memo = quality_classifier.shared_memo()
    assert quality_classifier.shared_memo() is memo
    coder = packing.tokenizer_for(WORDS)
    assert packing.tokenizer_for(WORDS) is coder and list(common._KEPT.values()) == [coder]
    assert quality_classifier.shared_memo() is not memo and packing.tokenizer_for(WORDS) is not coder
    common.forget_kept()
    assert not common._KEPT


def test_pieces_at_borders_of_letters_and_marks(coder):
    """Batches, in which words are cut from marks and share their first states, have the library's ids."""
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(6)
    parts = ["the", "ing", "a", "e", "é", "ж", "ы", "日", "ا", "².", "²", "½", "Ⅷ", "7", "٣", "_", "__", "._", "(_", ".", "...", "$$$", "'s", "-", "́", "👍", "▁", " ", "  ", "\n", "\n\n", "\t", "\xa0"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(3000)] + ["", " ", "\n", "x" * 100 + "." * 100]
    for some in (texts, texts[::-1], [], [""]):
        assert [x.tolist() for x in coder.encode_all(some)] == [sp.encode(t) for t in some]
    for piece in coder.ids:
        assert coder.stretch.findall(piece) == [piece]


def test_stretches_of_a_vocabulary_with_mixed_pieces():
    coder = sentencepieces.PieceCoder(PIECES)
    assert coder._stretches().findall("▁▁ab.c▁\nd²x²,") == ["▁▁ab", ".", "c", "▁", "\n", "d", "²", "x", "²,"]
    for mixed in ("a.", ".b", "a\n", "▁\n"):
        coder.ids = {"ab": 1, "bc": 2, mixed: 3}
        assert coder._stretches().findall("▁▁ab.c▁\nd²") == ["▁▁ab.c", "▁\nd²"]


def test_words_are_searched_once_whatever_marks_follow():
    class Counting(dict):
        asked = 0

        def get(self, key):
            Counting.asked += 1
            return super().get(key)

    coder = sentencepieces.PieceCoder(PIECES)
    coder.ends = Counting(coder.ends)
    r = random.Random(7)
    words = ["".join(r.choice("abcdetshing") for _ in range(9)) for _ in range(400)]
    coder.encode(" ".join(words))
    once, Counting.asked = Counting.asked, 0
    coder.encode(" ".join(w + mark for w in words for mark in ("", ",", ".", "&&&", "$$$")))
    assert Counting.asked < 0.05 * once
    for w in sorted({w[:8] + x for w in words for x in "kmw"}):
        coder.search("▁" + w)
    alone, Counting.asked = Counting.asked, 0
    coder.encode(" ".join(w[:8] + x for w in words for x in "kmw"))
    assert Counting.asked < 0.6 * alone
