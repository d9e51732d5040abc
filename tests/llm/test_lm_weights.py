"""The trained model against plain Python, and that scores don't depend on how data are laid out."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from motifmill.llm import lm_scoring as lm


def weights(n, q, variance):
    """Weights of a feature's outcomes at the maximum, one coordinate after another by bisection. n, q: by outcome."""
    w, total = dict.fromkeys(n, 0.0), sum(n.values())
    for _ in range(60):
        for o in n:
            others = 1 + sum(q[x] * (math.exp(w[x]) - 1) for x in n if x != o) - q[o]
            low, high = -30.0, 30.0
            while high - low > 1e-9:
                x = (low + high) / 2
                if n[o] - total * q[o] * math.exp(x) / (others + q[o] * math.exp(x)) - x / variance > 0:
                    low = x
                else:
                    high = x
            w[o] = low
    return w, math.log(1 + sum(q[o] * (math.exp(w[o]) - 1) for o in n))


def brute(rows, classes_of):
    """Document scores: rows of (doc_id, tokens, held out)."""
    count = Counter(w for _, ts, held in rows if not held for w in ts)
    code = lambda w: w if count[w] > 1 else zlib.crc32(w.encode()) % lm.TAIL_CODES
    unknown = (sum(n == 1 for n in count.values()) + 0.5) / lm.TAIL_CODES
    mass = Counter({k: unknown for k in range(lm.TAIL_CODES)})
    for w, n in count.items():
        mass[code(w)] += n
    of_class = Counter()
    for c, m in mass.items():
        of_class[classes_of(c)] += m
    all_mass = sum(mass.values())
    events = []
    for i, ts, held in rows:
        codes = [code(w) for w in ts]
        for at, w in enumerate(ts):
            h = tuple(codes[at - k] if at >= k else None for k in (1, 2, 3))
            skips = isinstance(h[0], int)
            features = [("skip", h[1]) if skips else h[0], ("skip", *h[:2]) if skips else h[:2], h]
            share = math.log((count[w] or unknown) / mass[code(w)]) if isinstance(code(w), int) else 0.0
            events.append([i, held, features, code(w), math.log(of_class[classes_of(code(w))] / all_mass), math.log(mass[code(w)] / of_class[classes_of(code(w))]), share])
    for level in range(3):
        for at, variance, outcome_of, feature_of in ((4, lm.CLASS_VARIANCE, lambda e: classes_of(e[3]), lambda e: e[2][level]), (5, lm.WORD_VARIANCE, lambda e: e[3], lambda e: (e[2][level], classes_of(e[3])))):
            n, q = defaultdict(Counter), defaultdict(dict)
            for e in events:
                if not e[1]:
                    n[feature_of(e)][outcome_of(e)] += 1
                q[feature_of(e)][outcome_of(e)] = math.exp(e[at])
            fitted = {f: weights(n[f], q[f], variance) for f in n}
            for e in events:
                w, log_z = fitted.get(feature_of(e), ({}, 0.0))
                e[at] += w.get(outcome_of(e), 0.0) - log_z
    score = Counter()
    for e in events:
        score[e[0]] += (e[4] + e[5] + e[6]) / math.log(10)
    return score


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def test_scores_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(lm, "TAIL_CODES", 64)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(12)] + [f"rare{i}" for i in range(40)]
    rows = [(i, rng.choices(vocabulary, [30 / (k + 1) if k < 12 else 0.3 for k in range(52)], k=rng.randint(0, 14))) for i in range(50)]
    by_name = lambda c: 3 if isinstance(c, int) else zlib.crc32(c.encode()) % 3
    monkeypatch.setattr(lm, "word_classes", lambda _, head, __: np.array([by_name(w) for w in head.words] + [3] * 64))
    expected = brute([(i, [*ws, lm.END], held(i)) for i, ws in rows], by_name)
    out = lm.score_documents(spark.createDataFrame([(i, " ".join(ws)) for i, ws in rows], "doc_id long, text string")).collect()
    assert len(out) == 50 and sum(r["held_out"] for r in out) > 5
    for r in out:
        assert abs(r["score"] - expected[r["doc_id"]]) < 1e-3 * max(1, r["n_tokens"] / 4), r


@pytest.fixture
def scores(spark, documents):
    text = documents.select("doc_id", "text").collect()
    # one word, one pair and one run of three words make up a third of all tokens each third of it
    text = [(r[0], f"{r[1] or ''} " + " hot pair hot pair x hot pair".join((r[1] or "").split(" ")[:300])) for r in text]
    return spark.createDataFrame(text, "doc_id long, text string").cache()


def test_scores_do_not_depend_on_layout(scores):
    key = lambda df: {r["doc_id"]: r["score"] for r in df.collect()}
    whole = key(lm.score_documents(scores))
    parts = key(lm.score_documents(scores.repartition(5, "text"), block_tokens=3000, shard_tokens=2000, hot_tokens=1000))
    assert whole.keys() == parts.keys() and all(abs(whole[k] - parts[k]) < 1e-6 for k in whole)


def test_long_documents_are_cut_into_segments(scores):
    key = lambda df: {r["doc_id"]: (r["n_tokens"], r["n_known"], r["score"]) for r in df.collect()}
    few = scores.limit(40)
    whole = key(lm.score_documents(few))
    rows = lm.stored(lm.coded(few, lm.head_of(lm.stored(lm.word_counts(few))), 500, 200))
    assert rows.where("exists(lead, x -> x > 0)").count() > 10
    cut = key(lm.score_documents(few, block_tokens=500, run_bytes=200))
    assert all(whole[k][:2] == cut[k][:2] and abs(whole[k][2] - cut[k][2]) < 1e-6 for k in whole)


def test_training_lowers_held_out_loss(spark):
    out = lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    base, score, tokens = (sum(r[c] for r in out) for c in ("base_score", "score", "n_tokens"))
    assert score / tokens - base / tokens > 0.5


def test_cells_alone_have_the_weights_of_plain_python(monkeypatch):
    """Features of one cell are trained apart; the others, and cells without tokens, aren't."""
    r = np.random.default_rng(5)
    size = r.integers(1, 4, 60)
    first = np.cumsum(size) - size
    n, q = r.integers(0, 4, size.sum()).astype(float), r.random(size.sum()) / 4
    given, alone = [], lm.trained_alone
    monkeypatch.setattr(lm, "trained_alone", lambda n, *rest: given.append(len(n)) or alone(n, *rest))
    found = lm.trained(first, n, q, 4.0)
    for a, k in zip(first, size, strict=True):
        w, log_z = weights({i: n[i] for i in range(a, a + k) if n[i]}, {i: q[i] for i in range(a, a + k)}, 4.0)
        assert found[a : a + k] == pytest.approx([math.log(q[i]) + w.get(i, 0) - log_z for i in range(a, a + k)], abs=1e-5)
    assert given == [sum((n[a : a + k] > 0).sum() == 1 for a, k in zip(first, size, strict=True))] and 0 < given[0] < 60
