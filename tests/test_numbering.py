"""Numbers in order, against sorting in Python."""

from __future__ import annotations

import random

from motifmill.operators.numbering import numbered


def test_groups_of_all_sizes_are_numbered(spark):
    pick = random.Random(4)
    rows = [(pick.choice(["hot"] * 6 + ["a", "b", None, ""]), pick.choice([None, *range(400)]), i) for i in range(1500)]
    got = numbered(spark.createDataFrame(rows, "g string, k long, i long"), ["g"], "k", "i", name="n", size="of").collect()
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["n"])
        assert [r["i"] for r in mine] == [r[2] for r in want] and [r["n"] for r in mine] == list(range(len(want)))
        assert {r["of"] for r in mine} == {len(want)}


def test_no_groups_ties_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 5), (1, 5), (0, 9)], "k int, idx int")
    assert sorted((r["k"], r["no"]) for r in numbered(rows, [], "k", name="no").collect()) == [(0, 0), (1, 1), (1, 2)]
    assert numbered(rows.limit(0), ["k"], "idx", name="no").count() == 0
    assert numbered(rows, [], "k", name="no").columns == ["k", "idx", "no"]
