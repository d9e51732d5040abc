"""Conversation repair against plain Python: a search over (cost, audit) pairs, and trying all edits of tiny conversations."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from hashlib import sha256

import pytest

from motifmill.llm import chat_repair

SPACE = " \t\n\x0b\x0c\r"


def sort_key(row):
    turn, role, text = row
    return turn is not None, turn or 0, role.encode(), text.encode()


def first_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = text.strip(SPACE)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def step(state, initial):
    return {"0s": "1", "0u": "2", "1u": "2", "2a": "3", "3u": "2"}.get(state + initial)


def repaired(rows, faults):
    """(cost, audit, lines): the least pair of cost and audit by going backwards over all rows and states."""
    best = {"0": (0, "", ()), "3": (0, "", ())}
    best["2"] = (3, "I", ("assistant:",))
    best["1"] = (6, "II", ("user:", "assistant:"))
    for (_, role, text), fault in zip(rows[::-1], faults[::-1], strict=True):
        now, extra = {}, 3 if fault == "truncated" else 0
        for s in "0123":
            some = [(4 + best[s][0], "D" + best[s][1], best[s][2])]
            if fault not in ("blank", "duplicate"):
                for edit, name, cost in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    to = step(s, name[:1])
                    if to:
                        some.append((cost + extra + best[to][0], edit + best[to][1], (f"{name}:{text}", *best[to][2])))
            now[s] = min(some)
        for _ in range(4):
            for s in "0123":
                name = "assistant" if s == "2" else "user"
                to = now[step(s, name[0])]
                now[s] = min(now[s], (3 + to[0], "I" + to[1], (f"{name}:", *to[2])))
        best = now
    return best["0"]


def summary(rows):
    rows = sorted(rows, key=sort_key)
    faults = first_faults(rows)
    cost, audit, lines = repaired(rows, faults)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest()


def test_plain_search_against_all_edits():
    pick = random.Random(1)
    inserts = [i for n in range(3) for i in itertools.product("ua", repeat=n)]
    for _ in range(25):
        rows = [(i, pick.choice(["user", "assistant", "system", "tool"]), pick.choice(["x.", "x", "", "y!"])) for i in range(2)]
        faults, found = first_faults(rows), []
        for edits in itertools.product("DKUA", repeat=2):
            for ins in itertools.product(inserts, repeat=3):
                word, cost, audit = "", 0, ""
                for i in range(3):
                    word, cost, audit = word + "".join(ins[i]), cost + 3 * len(ins[i]), audit + "I" * len(ins[i])
                    if i < 2:
                        gone = edits[i] == "D"
                        word += "" if gone else rows[i][1][0] if edits[i] == "K" else edits[i].lower()
                        cost += 4 if gone else (3 if edits[i] in "UA" else 0) + (3 if faults[i] == "truncated" else 0)
                        cost += 10_000 if not gone and faults[i] in ("blank", "duplicate") else 0
                        audit += "R" if edits[i] in "UA" else edits[i]
                if re.fullmatch("(s?(ua)+)?", word):
                    found.append((cost, audit))
        assert repaired(rows, faults)[:2] == min(found)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_key, turn_key = (" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(f"{conv_key}:{turn_key}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def check(spark, rows):
    schema = "conv_id long, turn long, role string, text string, at int, key int, rank int"
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], schema).repartition(3)
    got = chat_repair.repair(chat_repair.damaged(frame), frame).collect()
    kept, want = damage(rows), {}
    for conv in {r[0] for r in rows}:
        want[conv] = summary([r[1:] for r in kept if r[0] == conv])
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]], r["conv_id"]


def conversations(pick, n, most):
    out = []
    for conv in range(n):
        for turn in range(pick.randint(1, most)):
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            out.append((conv or None, pick.choice([turn, turn, turn, None, 3]), role, pick.choice([None, "", " \n", "Yes.", "No?", "Well", f"text {turn}!", "é" * turn, "Yes.\t"])))
    return out


def test_odd_conversations(spark):
    check(spark, conversations(random.Random(2), 150, 9))


@pytest.mark.parametrize(("bits", "runs"), [(0, (2, 3)), (1, (1, 2)), (2, (64, 4096))])
def test_chunks_are_stitched(spark, monkeypatch, bits, runs):
    """Conversations over many chunks; runs of one role, after which vectors never converge, and turns that must all go."""
    monkeypatch.setattr(chat_repair, "CHUNK_BITS", bits)
    monkeypatch.setattr(chat_repair, "RUNS", runs)
    pick = random.Random(bits)
    rows = conversations(pick, 6, 12)
    rows += [(100, i, "user", f"same role {i}.") for i in range(41)]
    rows += [(101, i, "assistant", f"same role {i}" + "." * (i % 3 > 0)) for i in range(30)]
    rows += [(102, None, "user", "same text.") for _ in range(25)]
    rows += [(103, i, "user" if i % 2 else "assistant", f"turn {i}.") for i in range(50)]
    rows += [(104, 2 * i, "system", f"turn {i}.") for i in range(30)]
    rows += [(105, i, "user", "long " * 30_000 + f"{i}.") for i in range(4)]
    check(spark, rows)


def test_empty_table_and_turns(spark):
    frame = spark.createDataFrame([(7, 0, "user", "Hi."), (7, 1, "user", "There."), (7, 2, "assistant", "No")], "conv_id long, turn long, role string, text string")
    assert chat_repair.repair(chat_repair.damaged(frame.limit(0)), frame.limit(0)).count() == 0
    got = sorted((r["chunk"], r["place"], r["edit"], r["role"], r["text"]) for r in chat_repair.repaired_turns(frame).collect())
    _, _, lines = repaired([(0, "user", "Hi."), (1, "user", "There."), (2, "assistant", "No")], [None, None, "truncated"])
    assert [f"{role}:{text}" for *_, role, text in got] == list(lines)
