import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from motifmill.llm import common, components, exact_dedup, line_dedup, simhash
from motifmill.llm.components import components as connected


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_golomb_round_trip(n):
    v = np.unique(np.random.default_rng(n).integers(0, 1 << 48, n))
    assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(v), len(v)) == v).all()


def test_golomb_dense():
    v = np.array([0, 1, 2, 3, 1 << 40])
    assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(v), len(v)) == v).all()


def brute_exact(rows):
    out = []
    for i, t in rows:
        ids = [j for j, u in rows if u == t]
        keep = max((j for j in ids if j is not None), default=None)
        out.append((i, keep if keep is not None else i, len(ids), i == (keep if keep is not None else i), hashlib.sha256(t.encode()).hexdigest()))
    return out


def test_exact_dedup(spark, odd, documents):
    for df, rows in ((odd, 3), (documents, 20)):
        got = [tuple(r) for r in exact_dedup.exact_dedup(df, rows_per_sender=rows).collect()]
        assert sorted(map(str, got)) == sorted(map(str, brute_exact(pairs(df))))
    assert exact_dedup.exact_dedup(odd.where("false")).count() == 0
    hot = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) as text")
    rows = exact_dedup.exact_dedup(hot, rows_per_sender=100).where("group_size > 1")
    assert rows.count() == 1000 and rows.where("kept").collect()[0]["doc_id"] == 2997


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(500, 500 + i) for i in range(50)] + [(600 + i, 601 + i) for i in range(60)]
    root = list(range(700))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {x["node"]: x["root"] for x in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1] or find(x) != x or x in got}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components.components is connected


def brute_simhash(rows):
    prints = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    f, root = np.array(prints, np.uint64), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in np.flatnonzero(np.bitwise_count(f[a + 1 :] ^ f[a]) <= 3):
            x, y = sorted((find(a), find(a + 1 + b)))
            root[y] = x
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, f"{prints[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize(("short", "block"), [(48, 1024), (3, 8)])
def test_simhash(spark, odd, documents, monkeypatch, short, block):
    monkeypatch.setattr(simhash, "SHORT_LIST", short)
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(2)
    base = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho".split() * 20
    near = []
    for i in range(300):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = str(r.randrange(50))
        near.append((10_000 + i, " ".join(w)))
    df = odd.select("doc_id", "text").where("doc_id is null or doc_id <> 6").unionByName(documents.select("doc_id", "text").withColumn("doc_id", documents.doc_id + 100)).unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    got = [(x["doc_id"], x["fingerprint"], x["component_id"]) for x in simhash.near_duplicates(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_simhash(pairs(df))))


def test_simhash_empty(odd):
    assert simhash.near_duplicates(odd.where("false")).count() == 0


def brute_lines(rows, min_words):
    rows = sorted(set(rows), key=lambda r: (-(2**63) if r[0] is None else r[0], r[1]))
    first, gone = {}, [set() for _ in rows]
    for d, (_, t) in enumerate(rows):
        lines = t.split("\n")
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += len(lines[b].encode().split())
                if n >= min_words and first.setdefault(tuple(lines[a : b + 1]), (d, a)) != (d, a):
                    gone[d] |= set(range(a, b + 1))
    return {r: "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in g) for r, g in zip(rows, gone, strict=True)}


@pytest.mark.parametrize("min_words", [1, 6, 12])
def test_line_dedup(spark, min_words):
    r = random.Random(min_words)
    lines = ["a b c", "d e", "f g h i", "x", "", "q r s", "t u v w y"]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(9)))) for i in range(90)] + [(3, "x"), (3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_lines(rows, min_words)
    got = [tuple(x) for x in df.select("doc_id", "text").join(line_dedup.line_dedup(df, min_words).selectExpr("doc_id", "text as new", "n_lines"), "doc_id").collect()]
    rows_out = line_dedup.line_dedup(df, min_words).collect()
    assert len(rows_out) == len(rows) and got
    by_id = {i: t for (i, _), t in expected.items() if i != 3}
    assert all(x["text"] == by_id[x["doc_id"]] and x["n_deleted"] <= x["n_lines"] for x in rows_out if x["doc_id"] != 3)


def test_line_dedup_odd(odd, documents):
    out = line_dedup.line_dedup(odd, 3).collect()
    assert len(out) == odd.count() and odd.columns == ["doc_id", "text", "kept", "n_lines"] and set(out[0].asDict()) == {"doc_id", "text", "kept", "n_lines", "n_deleted"}
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[0]["text"] is None and by_id[8]["text"] == "same words here" and by_id[9]["text"] == "" and by_id[9]["n_deleted"] == 1
    assert by_id[4]["text"] == "one two three four five"  # rows that repeat id and text are one document
    assert line_dedup.line_dedup(odd.where("false")).count() == 0
    rows = pairs(documents)
    got = {(r["doc_id"]): r["text"] for r in line_dedup.line_dedup(documents).collect()}
    assert got == {i: t for (i, _), t in brute_lines(rows, 50).items()}


def test_texts_without_cuts_stay_in_place(spark):
    """Only documents that may lose lines are shuffled with their texts: a bitmap of those with cuts tells the two apart."""
    keys = [r.randrange(-(2**63), 2**63) for r in [random.Random(4)] for _ in range(3000)]
    rows = spark.createDataFrame([(k, str(k)) for k in keys] + [(7, "7")], "key long, text string")
    marks = spark.createDataFrame([(k,) for k in keys[:900]], "key long")
    may, no = common.split_by_marks(rows, "key", marks)
    found, rest = ({x["text"] for x in part.collect()} for part in (may, no))
    assert {str(k) for k in keys[:900]} <= found and not found & rest and len(found) + len(rest) == 3001 and len(found) < 900 + 2100 / 6
    none, every = common.split_by_marks(rows, "key", marks.where("false"))
    assert none.count() == 0 and every.count() == 3001 and set(every.columns) == {"key", "text"}
    plan = no._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_line_run_in_most_documents(spark):
    """A block that half of all documents share, and one that only their later halves do."""
    block = "\n".join(f"word{i} a b c d e f g h" for i in range(8))
    rows = [(i, f"own {i}\n" + (block if i % 2 else f"text {i}") + f"\nend {i}") for i in range(2000)]
    out = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["text"] == rows[1][1] and all(out[i]["text"] == f"own {i}\nend {i}" and out[i]["n_deleted"] == 8 for i in range(3, 2000, 2))
    assert all(out[i]["text"] == rows[i][1] and out[i]["n_lines"] == 3 for i in range(0, 2000, 2))


def test_simhash_count_filter(spark):
    """Of the pairs that meet in a list, the tally of shared bytes alone rejects most, and none that is near."""
    r, prints = random.Random(8), set()
    alphabet = [[r.randrange(256) for _ in range(5)] for _ in range(8)]
    for _ in range(500):
        fp = sum(r.choice(a) << 8 * p for p, a in enumerate(alphabet))
        prints |= {fp, fp ^ 1 << r.randrange(64) ^ 1 << r.randrange(64)}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    posted = spark.createDataFrame([(x,) for x in signed], "fp long").select("fp", F.explode(simhash._postings(F.col("fp"))).alias("list"))
    met = posted.join(posted.withColumnRenamed("fp", "other"), "list").where("fp < other").select("fp", "other").distinct()
    rows = met.select("fp", "other", simhash.tally(F.col("fp"), F.col("other")).alias("shared")).collect()
    kept = {(x["fp"], x["other"]) for x in rows if x["shared"] >= simhash.LEAST_SHARED}
    assert all(x["shared"] == sum(((x["fp"] ^ x["other"]) >> 8 * p & 255) == 0 for p in range(8)) >= 3 for x in rows)
    near = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert near and near <= kept and 2 * len(kept) < len(rows)


def test_simhash_clashing_names(odd):
    plain = [tuple(r) for r in simhash.near_duplicates(odd).collect()]
    more = odd.selectExpr("doc_id", "text", "kept as fp", "n_lines as component_id", "kept as fingerprint", "kept as text_hash", "n_lines as list", "n_lines as least", "n_lines as root")
    assert sorted(map(str, plain)) == sorted(map(str, [tuple(r) for r in simhash.near_duplicates(more).collect()]))
