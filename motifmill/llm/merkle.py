"""A Merkle manifest of a data set: a hash tree for each group of rows, one over the groups' roots, proofs and their folding.

Leaves are ordered within their group, and every 16 consecutive nodes make one of the next level until one is left. A *superblock* is
16**3 consecutive leaves of a group:

1. Each superblock is reduced to its top node.
2. The few nodes above superblocks are reduced level by level by `groupBy`, first within groups, then over the groups' roots. Going down
   again, each node hands its own path (its place in its run, and the run) to at most 16 children, so no key of these joins is hot.
3. Subtree exchange: leaves and the outer nodes that their superblock needs are cogrouped by superblock. One `applyInPandas` reduces the
   leaves again, joins the proofs from inner and outer nodes, and folds them.

A group of any size is spread over its superblocks; no task sees more than one of them at a time, nor more than 16 outer nodes a level.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import stored

#: Nodes that make one of the next level, and levels of a superblock.
ARITY = 16
LOCAL_LEVELS = 3
SUPERBLOCK = ARITY**LOCAL_LEVELS
#: The columns that a leaf covers, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_of(values: list[Column]) -> Column:
    """SHA-256 of the values, each `-` if null, else the length of its text in bytes, a colon and the text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def height(n: int) -> int:
    """Levels above `n` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def _runs(nodes: DataFrame) -> DataFrame:
    """nodes: (tree, size, idx, digest) of one level. The runs of the next one: (tree, size, idx, run, digest)."""
    members = F.sort_array(F.collect_list(F.struct("idx", "digest")))  # at most 16
    run = nodes.groupBy("tree", "size", F.shiftright("idx", 4).alias("up")).agg(F.transform(members, lambda x: x["digest"]).alias("run"))
    return run.select("tree", "size", F.col("up").alias("idx"), "run", F.sha2(F.array_join("run", ""), 256).alias("digest"))


def _levels(nodes: DataFrame, first: int, largest: int) -> dict[int, DataFrame]:
    """The runs of every level above `first`, where `nodes` are; `largest`: the leaves of the largest tree."""
    out = {}
    for level in range(first + 1, height(largest) + 1):
        out[level] = stored(_runs(nodes.where(F.col("size") > ARITY ** (level - 1))), "runs")
        nodes = out[level].drop("run")
    return out


def _descend(runs: DataFrame, paths: DataFrame) -> DataFrame:
    """paths: (tree, idx, path, ...) of one level. Those of their children: a child's path begins with its place and its run."""
    step = runs.select("tree", "idx", "run").join(paths, ["tree", "idx"]).select("*", F.posexplode("run").alias("at", "__own"))
    path = F.concat(F.array(F.struct(F.col("at"), F.col("run"))), F.col("path"))
    return step.withColumn("path", path).withColumn("idx", F.col("idx") * ARITY + F.col("at")).drop("run", "at", "__own")


def _reduced(leaves: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level, the leaves first."""
    out = [leaves]
    for _ in range(levels):
        below = out[-1]
        out.append([digest("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    return out


def _local_levels(size: int) -> int:
    return min(LOCAL_LEVELS, height(size))


def _top(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    nodes = _reduced(rows.sort_values("idx")["leaf"].tolist(), _local_levels(int(rows["size"].iloc[0])))
    return pd.DataFrame({"tree": [key[0]], "idx": [key[1]], "size": [rows["size"].iloc[0]], "digest": nodes[-1]})


def _proofs(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("idx")
    own = outer.iloc[0]
    nodes = _reduced(rows["leaf"].tolist(), _local_levels(int(rows["size"].iloc[0])))
    above = [(int(x["at"]), list(x["run"])) for x in own["path"]]
    proofs, folded = [], []
    for i, candidate in enumerate(rows["candidate"].tolist()):
        path, at = [], i
        for below in nodes[:-1]:
            first = at - at % ARITY
            path.append((at - first, below[first : first + ARITY]))
            at //= ARITY
        siblings, now = [], candidate
        for place, run in (*path, *above):
            before, after = "".join(run[:place]), "".join(run[place + 1 :])
            siblings += (before, after)
            now = digest(before + now + after)
        proofs.append(digest("".join(siblings)))
        folded.append(now)
    return rows[["key", "leaf"]].assign(subroot=own["subroot"], root=own["root"], proof_sha256=proofs, folded_root=folded)


def prove(leaves: DataFrame) -> DataFrame:
    """leaves: (group, key, leaf, candidate), digests as hex text. One row for each: (key, leaf, subroot, root, proof_sha256,
    folded_root).

    In a group (null is one, and the first) leaves ascend by key, null first, then by leaf, so repeated rows are leaves of their own.
    A proof is the digest of all siblings, from the leaf's run up to the root, left to right; folding replaces the leaf by the
    candidate. A group of one leaf has it as its root, a single group's root is the root of all. An empty table gives no rows.
    """
    laid = numbered(leaves, ["group"], "key", "leaf", name="idx", size="size")
    groups = stored(numbered(laid.select("group", "size").distinct(), [], "group", name="tree", size="trees"), "groups")
    rows = laid.join(groups.select(F.col("group").alias("__group"), "tree"), F.col("group").eqNullSafe(F.col("__group")))
    rows = stored(rows.select("tree", "size", "idx", F.shiftright("idx", 4 * LOCAL_LEVELS).alias("block"), "key", "leaf", "candidate"), "leaves")
    largest, trees = groups.agg(F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.max("trees"), F.lit(0))).first()

    tops = stored(rows.select("tree", "block", "idx", "size", "leaf").groupBy("tree", "block").applyInPandas(_top, "tree long, idx long, size long, digest string"), "tops")
    inner = _levels(tops.where(F.col("size") > SUPERBLOCK), LOCAL_LEVELS, largest)
    subroots = tops.where(F.col("size") <= SUPERBLOCK).select("tree", "digest")
    for level, runs in inner.items():
        subroots = subroots.unionByName(runs.where(F.col("size") <= ARITY**level).select("tree", "digest"))
    subroots = stored(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("size"), F.col("tree").alias("idx"), "digest"), "subroots")

    upper = _levels(subroots, 0, trees)
    last = upper[max(upper)] if upper else subroots
    paths = last.select("tree", "idx", F.col("digest").alias("root"), F.expr("cast(array() as array<struct<at: int, run: array<string>>>)").alias("path"))
    for level in sorted(upper, reverse=True):
        paths = _descend(upper[level], paths)
    of_tree = stored(
        paths.select("idx", "root", "path").join(subroots.select("idx", F.col("digest").alias("subroot")), "idx").withColumnRenamed("idx", "tree").join(groups.select("tree", "size"), "tree"), "paths"
    )

    def entering(level: int) -> DataFrame:
        """Paths of the trees whose highest node is of this level; all smaller trees are one superblock."""
        fits = (F.col("size") > ARITY ** (level - 1)) if level > LOCAL_LEVELS else F.lit(True)
        return of_tree.where((F.col("size") <= ARITY**level) & fits).withColumn("idx", F.lit(0).cast("long"))

    highest = max(inner, default=LOCAL_LEVELS)
    paths = entering(highest)
    for level in range(highest, LOCAL_LEVELS, -1):
        paths = _descend(inner[level], paths).unionByName(entering(level - 1))
    outer = stored(paths.select("tree", F.col("idx").alias("block"), "path", "subroot", "root"), "outer")
    kind = leaves.schema["key"].dataType.simpleString()
    return rows.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(
        _proofs, f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    )


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "source", found: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of `docs`: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified).

    `found` gives what a reader found in place of some columns: a row is verified if the leaf of what was found folds to the root.
    Nulls in any column, empty texts, repeated rows and ids, and texts of any length have leaves as any others. Only the named columns
    are read.
    """
    named = {c: F.col(f"`{c}`") for c in columns}
    leaves = docs.select(
        F.col(f"`{group_col}`").cast("string").alias("group"), F.col(f"`{id_col}`").alias("key"), leaf_of(list(named.values())).alias("leaf"),
        leaf_of([(found or {}).get(c, v) for c, v in named.items()]).alias("candidate"),
    )
    return prove(leaves).withColumnRenamed("key", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(doc_id: Column, text: Column) -> Column:
    """The text in lower case (A-Z) where 5 divides the crc32 of the id as decimal text."""
    return F.when(F.crc32(doc_id.cast("string")) % 5 == 0, lower_ascii(text)).otherwise(text)
