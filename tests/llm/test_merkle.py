"""The Merkle manifest against plain Python."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from motifmill.llm import merkle


def h(text):
    return sha256(text.encode()).hexdigest()


def build(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def climb(levels, i, now, siblings):
    for level in levels[:-1]:
        first = i - i % 16
        run = level[first : first + 16]
        siblings += run[: i - first] + run[i - first + 1 :]
        now = h("".join(run[: i - first] + [now] + run[i - first + 1 :]))
        i //= 16
    return now


def brute(rows):
    """rows: (group, key, leaf, candidate). {(key, leaf): (subroot, root, proof, folded)} with lists for repeated rows."""
    groups = {}
    for g, k, leaf, cand in rows:
        groups.setdefault(g, []).append((k is not None, k or 0, leaf, cand, k))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: build([x[2] for x in sorted(groups[g])]) for g in order}
    top = build([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for i, (_, _, leaf, cand, k) in enumerate(sorted(groups[g])):
            siblings = []
            now = climb(top, at, climb(trees[g], i, cand, siblings), siblings)
            out.append((k, leaf, trees[g][-1][0], top[-1][0], h("".join(siblings)), now))
    return out


def text_key(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize(("hot", "others"), [(5000, 300), (1, 0), (16, 1), (17, 15), (257, 17), (4096, 3), (4097, 0)])
def test_trees_of_all_sizes(spark, hot, others):
    pick = random.Random(hot)
    rows = [("hot", i, h(f"hot{i}"), h(f"hot{i}" + "x" * (i % 5 == 0))) for i in range(hot)]
    for g in range(others):
        rows += [(None if g == 7 else f"g{g}é", i, h(f"{g}.{i}"), h(f"{g}.{i}")) for i in range(pick.choice([1, 1, 2, 16, 17]))]
    pick.shuffle(rows)
    got = merkle.prove(spark.createDataFrame(rows, "group string, key long, leaf string, candidate string")).collect()
    assert text_key(map(tuple, got)) == text_key(brute(rows))


def fields(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def test_odd_rows(spark):
    docs = [(5, "Ab", "x", "en", 2), (5, "Ab", "x", "en", 2), (None, None, None, None, None), (None, "", "", "", 0), (25, "É B" * 400_000, None, "fr", -7), (3, "ABC", "x\n", "en", 3)]
    docs += [(i, f"Text {i}", "x", None, i) for i in range(40)]
    frame = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, source string, lang string, n_chars long, key int, leaf int, idx int")
    rows = []
    for i, text, source, lang, n in docs:
        bad = i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and text is not None
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if bad else text
        rows.append((source, i, fields(i, source, lang, n, text), fields(i, source, lang, n, low)))
    got = merkle.manifest(frame, found={"text": merkle.tampered(F.col("doc_id"), F.col("text"))})
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert text_key(tuple(r) for r in got.collect()) == text_key((*r, r[5] == r[3]) for r in brute(rows))
    assert {r["verified"] for r in got.collect()} == {True, False}
    whole = merkle.manifest(frame)
    assert whole.where("not verified").count() == 0
    assert merkle.manifest(frame.limit(0)).count() == 0
