import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from motifmill.llm import quality_classifier as qc
from motifmill.llm import quality_rules as qr


def test_features_are_averages():
    memo = qc.new_memo()
    at, value = qc.features(b"one two one", memo)
    assert len(set(at)) == len(at) and np.isclose(value.sum(), 2) and len(qc.features(b" ", memo)[0]) == 0


def test_ftrl_separates_and_ignores_order_of_fresh_features():
    rows = [(i % 2, np.array([i % 2, 5]), np.array([1.0, 0.5], np.float32)) for i in range(200)]
    m = qc.ftrl(rows)
    assert m.weights[1] > 0.3 > -0.3 > m.weights[0]


def test_classifier(spark, odd, documents, labels):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = qc.train(big, marks)
    rows = qc.classify(big, model).join(marks, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == (r["quality"] > 0) for r in held) / len(held) > 0.93
    out = qc.classify(odd, model).collect()
    assert len(out) == odd.count() and len({r["score"] for r in out if r["doc_id"] in (0, 1, 2)}) == 1 and all(0 <= r["score"] <= 1 for r in out)
    assert qc.classify(odd.where("false"), model).count() == 0
    assert [round(r[0], 9) for r in odd.select(qc.score_column(model, odd.text, spark)).collect()] == [round(r["score"], 9) for r in out]
    none = qc.train(documents, labels.where("false"))
    assert {r["score"] for r in qc.classify(documents, none).collect()} == {0.5}


def test_driver_holds_features_once():
    """Training views them in the buffers that they came in."""
    rows = [np.arange(n, dtype=np.float32) for n in (3, 0, 1, 1000, 0)]
    whole = pa.array([x.tobytes() for x in rows], pa.binary())
    for part, expected in ((whole, rows), (whole.slice(1, 3), rows[1:4]), (whole.cast(pa.large_binary()), rows), (whole.slice(5), [])):
        found = qc._views(part, np.float32)
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(found, expected, strict=True))
    start, size = whole.buffers()[2].address, whole.buffers()[2].size
    assert all(start <= x.ctypes.data < start + size for x in qc._views(whole, np.float32) if len(x))


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    marked = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(marked))


def test_counts(odd, documents):
    texts = [r["text"] or "" for df in (odd, documents) for r in df.where("length(text) < 20000").collect()] + ["a b c d e f a b c d e f g", "a " * 12, "x y\nx y\n\n \nx y"]
    for t in texts:
        assert qr.statistics(t.encode())[0] == brute_counts(t)


def test_trees_keep_their_signs():
    r = np.random.default_rng(0)
    x = r.random((600, 3))
    y = (x[:, 0] + 0.3 * np.sin(12 * x[:, 1]) + 0.2 * r.random(600) > 0.7).astype(float)
    trees = qr.boost(x, y, [1, -1, 0])
    assert ((trees.score(x) > 0.5) == y).mean() > 0.85
    for f, sign in ((0, 1), (1, -1)):
        for row in x[:40]:
            line = np.repeat(row[None], 50, 0)
            line[:, f] = np.linspace(0, 1, 50)
            assert (np.diff(trees.score(line)) * sign >= -1e-12).all()


def test_rules(spark, odd, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    trees = qr.train(docs, marks)
    rows = qr.apply_rules(docs, trees).join(marks, "doc_id").collect()
    assert np.mean([r["kept"] for r in rows if r["quality"] == 0]) < 0.1
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]]) > 0.97
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["kept"] and r["base_failed"]) for r in rows)
    out = qr.apply_rules(odd, trees).collect()
    assert len(out) == odd.count() and all(r["base_failed"] for r in out if r["doc_id"] in (0, 1, 2, 6))
    assert [r[0] for r in odd.select(qr.kept_column(trees, odd.text, spark)).collect()] == [r["kept"] for r in out]
    assert qr.apply_rules(odd.where("false"), trees).count() == 0
    free = qr.train(docs, marks.where("false"))
    assert qr.apply_rules(docs, free).where("kept = base_failed").count() == 0


def plain_features(text):
    """The classifier's features, one by one."""
    mix = lambda a, b: ((a * 0x9E3779B1 + b) * 0x85EBCA6B % (1 << 64)) >> 7 & 0xFFFFFFFF
    words = text.encode().split()
    ids = [zlib.crc32(w.lower()) for w in words]
    shapes = [77 if i and w == words[i - 1] else qc._shape(w) for i, w in enumerate(words)]
    pairs = [mix(a, b) for a, b in zip(shapes, shapes[1:], strict=False)]
    lexical = [x % (1 << qc.HASH_BITS) for x in ids + [mix(a, b) for a, b in zip(ids, ids[1:], strict=False)]]
    formal = [(1 << qc.HASH_BITS) + x % (1 << qc.SHAPE_BITS) for x in shapes + pairs + [mix(p, s) for p, s in zip(pairs, shapes[2:], strict=False)]]
    out = Counter()
    for family in (lexical, formal):
        for x in family:
            out[x] += 1 / len(family)
    return out


def test_classifier_against_plain_python(spark, documents, labels):
    """Scores equal those of FTRL over dicts, a coordinate at a time."""
    quality = {r["doc_id"]: r["quality"] > 0 for r in labels.collect()}
    rows = sorted((zlib.crc32(b"%d" % r["doc_id"]), quality[r["doc_id"]], plain_features(r["text"] or "")) for r in documents.collect() if quality.get(r["doc_id"]) is not None and zlib.crc32(b"%d" % r["doc_id"]) % 5)
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= 1e-4 else -(z[i] - np.copysign(1e-4, z[i])) / (1 + n[i] ** 0.5 + 1e-3)

    def score(found):
        return float(1 / (1 + np.exp(-weight("bias") - sum(weight(i) * v * qc.SCALE for i, v in found.items()))))

    for _ in range(3):
        for _, y, found in rows:
            p = score(found)
            for i, x in [*((i, v * qc.SCALE) for i, v in found.items()), ("bias", 1.0)]:
                g, w = (p - y) * x, weight(i)
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) * w
                n[i] += g * g
    got = {r["doc_id"]: r["score"] for r in qc.classify(documents, qc.train(documents, labels)).collect()}
    expected = {r["doc_id"]: score(plain_features(r["text"] or "")) for r in documents.collect()}
    assert rows and got.keys() == expected.keys() and max(abs(got[i] - expected[i]) for i in got) < 1e-4


def plain_trees(x, y, signs, rounds=40, depth=3, rate=0.25, bins=64):
    """Margins of the training rows after boosting, a bin and a row at a time."""
    edges = [sorted({sorted(c)[int(q * (len(c) - 1))] for q in np.linspace(0, 1, bins + 1)[1:-1]}) for c in zip(*x, strict=True)]
    codes = [[sum(e < v for e in edges[f]) for f, v in enumerate(row)] for row in x]
    margin = [float(np.log((sum(y) + 0.5) / (len(y) - sum(y) + 0.5)))] * len(y)

    def grow(rows, level, low, high):
        total = lambda v, some: float(np.array([v[i] for i in some]).sum())
        value = lambda g, h: min(max(-rate * g / (h + 1), low), high)
        g, h, best = total(grad, rows), total(hess, rows), (1e-6, None)
        for f in range(len(signs)) if level < depth else ():
            sums = [[0.0, 0.0] for _ in range(len(edges[f]) + 1)]
            for i in rows:
                sums[codes[i][f]][0] += grad[i]
                sums[codes[i][f]][1] += hess[i]
            gl, hl = 0.0, 0.0
            for b, (dg, dh) in enumerate(sums[:-1]):
                gl, hl = gl + dg, hl + dh
                fits = hl >= 1 and h - hl >= 1 and (value(g - gl, h - hl) - value(gl, hl)) * signs[f] >= 0
                gain = gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1)
                if fits and gain > best[0]:
                    best = (gain, (f, b))
        if not best[1]:
            for i in rows:
                margin[i] += value(g, h)
            return
        f, b = best[1]
        parts = [[i for i in rows if codes[i][f] <= b], [i for i in rows if codes[i][f] > b]]
        mid = sum(value(total(grad, p), total(hess, p)) for p in parts) / 2
        bounds = {0: [(low, high)] * 2, 1: [(low, mid), (mid, high)], -1: [(mid, high), (low, mid)]}[int(np.sign(signs[f]))]
        for part, (a, c) in zip(parts, bounds, strict=True):
            grow(part, level + 1, a, c)

    for _ in range(rounds):
        p = [float(1 / (1 + np.exp(-m))) for m in margin]
        grad, hess = [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]
        grow(range(len(y)), 0, -np.inf, np.inf)
    return margin


def test_rules_against_plain_python(spark, odd, documents, labels):
    """The trees' scores equal plain boosting on the labelled rows, and every verdict a walk from node to node."""
    trees = qr.train(documents, labels)
    quality = {r["doc_id"]: r["quality"] > 0 for r in labels.collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in documents.collect()}
    ids = [i for i in sorted(texts) if quality.get(i) is not None and zlib.crc32(b"%d" % i) % 5]
    margin = plain_trees([list(map(float, qr.statistics(texts[i])[1])) for i in ids], [float(quality[i]) for i in ids], list(qr.STATISTICS.values()))
    got = {r["doc_id"]: r for r in qr.apply_rules(documents, trees).collect()}
    assert ids and max(abs(got[i]["score"] - 1 / (1 + np.exp(-m))) for i, m in zip(ids, margin, strict=True)) < 1e-6

    def walk(x):
        total = trees.bias
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] if x[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        return 1 / (1 + np.exp(-total))

    for df in (documents, odd):
        expected = []
        for r in df.collect():
            counts, x = qr.statistics((r["text"] or "").encode())
            failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
            expected.append((r["doc_id"], failed, not failed and bool(walk(x) >= qr.THRESHOLD)))
        assert sorted(map(str, expected)) == sorted(str((r["doc_id"], r["base_failed"], r["kept"])) for r in qr.apply_rules(df, trees).collect())
