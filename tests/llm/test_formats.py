import gzip
import hashlib
import io
import json

import pytest

from motifmill.llm import chat, warc


@pytest.mark.parametrize("version", [1, 2])
def test_arc_to_warc(version):
    records = [warc.ArcRecord(f"http://a/{i}", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\n\r\n" + b"\n\nno header line 5\n" * i) for i in range(4)]
    assert list(warc.arc_records(io.BytesIO(warc.arc_archive(records, version)))) == records
    (fields, block), = warc.warc_records(io.BytesIO(warc.warc_record(records[2], 7)))
    assert fields["warc-date"] == "2001-02-03T04:05:06Z" and fields["warc-type"] == "response" and fields["warc-page-id"] == "7" and block == records[2].block
    (fields, block), = warc.warc_records(io.BytesIO(warc.warc_record(records[2], 7, 9)))
    assert fields["warc-type"] == "revisit" and fields["warc-refers-to"] == warc.record_id(9, hashlib.sha1(warc.split_http(records[2].block)[1]).hexdigest()) and block == b"HTTP/1.0 200 OK\r\n\r\n"


def test_damaged_archives():
    good = warc.arc_archive([warc.ArcRecord("u", "0.0.0.0", "2001", "text/html", b"abc")], 1)
    for bad in (good[:-3], good.replace(b"text/html 3", b"text/html x"), good.replace(b"text/html 3", b"text html 3"), b"no version 0\n" + good):
        with pytest.raises(ValueError):
            list(warc.arc_records(io.BytesIO(bad)))
    with pytest.raises(ValueError):
        list(warc.warc_records(io.BytesIO(warc.warc_record(warc.ArcRecord("u", "i", "2001", "t", b"abc"), 1)[:-6])))


def test_archive_pages(spark, tmp_path):
    x = "p" * 1500
    rows = [(1, "http://a b/", x), (2, None, x), (3, "u", x), (3, "u", x), (4, "u", None), (5, "u", "é" * 400), (6, "u", "é" * 400), (7, "u", "HTTP/1.1 x\r\n\r\nWARC/1.1\r\n\r\n" * 100), (None, "n", x), (8, "u", "WARC/1.1\r\n")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")
    got = sorted(map(str, (tuple(r) for r in warc.archive_pages(df).collect())))
    expected = []
    for i, _, html in rows:
        data = (html or "").encode()
        to = 3 if html == x and i != 3 else None
        expected.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if to else "response", to))
    assert got == sorted(map(str, expected))
    assert warc.archive_pages(df.where("false")).count() == 0
    warc.write_archives(df, str(tmp_path / "w"))
    data = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").rglob("*.gz"))
    assert len(list(warc.warc_records(io.BytesIO(data)))) == len(rows)
    back = {r["page_id"]: r["payload"] for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert bytes(back[7]).decode() == rows[7][2] and back[1] is None and bytes(back[8]) == b"WARC/1.1\r\n"


def test_archives_of_long_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 20)
    long = "<p>é " * 700_000
    rows = [(i, "u", "x" * 200_000 + str(i % 9)) for i in range(12)] + [(20, "u", long), (21, "u", long), (None, "u", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"))
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "w").rglob("*.gz")]
    assert len(sizes) > 3 and sum(n > 1 << 21 for n in sizes) == 1  # the one long response has a file of its own
    got = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    kind = lambda i, to: ("response", None) if i == to else ("revisit", to)
    assert got == {(i, len(h.encode()), *kind(i, 21 if h == long else i if i % 9 > 2 else 9 + i % 9)) for i, _, h in rows}


CALLS = [
    (1, 1, "a", "search", '{"limit":3,"query":"x"}', []), (1, 3, "b", "translate", '{"to":"xx","text":"é"}', ["a"]), (1, 5, "c", "measure", '{"text":1,"scale":2}', ["b", "a"]), (1, 6, "c", "measure", '{"text":"1","scale":2.50}', ["b", "a"]),
    (1, 7, "d", "nope", "[1]", ["zz"]), (1, 8, "e", "search", "oops", ["f"]), (1, 9, "f", "search", '{"query":"q","limit":"1","more":null}', ["e"]), (1, 10, "g", "search", '{"limit":1}', ["f"]),
    (2, 1, "a", "search", '{"query":"q","limit":1}', None), (2, 1, None, "search", None, []), (None, 1, "a", "search", '{"query":"q","limit":1}', None),
]
RESULTS = [(1, 2, "a", "ra"), (1, 4, "b", "rb"), (1, 4, "b", "rb2"), (1, 4, "q", "rq"), (2, 2, "a", "r2"), (2, 2, None, "r3")]


def frames(spark, calls=CALLS, results=RESULTS):
    return (
        spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>"),
        spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"),
        spark.createDataFrame(chat.TOOLS, "name string, schema string"),
    )


def test_linking(spark):
    out = chat.link_tool_calls(*frames(spark)).collect()
    got = {(r["conv_id"], r["turn"], r["call_id"]): (r["level"], r["has_result"], r["errors"]) for r in out}
    assert got == {
        (1, 1, "a"): (0, True, []), (1, 3, "b"): (1, True, ["1 duplicate results", "enum: to"]), (1, 5, "c"): (2, False, ["no result", "type: text"]), (1, 6, "c"): (None, False, ["duplicate call"]),
        (1, 7, "d"): (0, False, ["missing call: zz", "no result", "unknown tool"]), (1, 8, "e"): (None, False, ["arguments are not an object", "cycle", "no result"]),
        (1, 9, "f"): (None, False, ["cycle", "no result", "type: limit", "unknown: more"]), (1, 10, "g"): (None, False, ["cycle", "missing: query", "no result"]), (1, 4, "q"): (None, True, ["no call"]),
        (2, 1, "a"): (0, True, []), (2, 1, None): (None, False, ["arguments are not an object", "no id"]), (2, 2, None): (None, True, ["no call"]), (None, 1, "a"): (None, False, ["no id"]),
    }
    for r in out:
        assert r["line"] == json.dumps(json.loads(r["line"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for conv in (1, 2, None):
        rows = sorted((r for r in out if r["conv_id"] == conv), key=lambda r: r["position"])
        assert [r["position"] for r in rows] == list(range(len(rows)))
        assert [r["level"] for r in rows] == sorted((r["level"] for r in rows), key=lambda x: 99 if x is None else x)
    calls, results, tools = frames(spark)
    assert chat.link_tool_calls(calls.where("false"), results.where("false"), tools).count() == 0


def brute_query(turns):
    """Levels and validity of the calls made of turns: only by their places and lengths."""
    users = {(t["conv_id"], t["turn"]) for t in turns if t["role"] == "user"}

    def level(c, t):
        parent = t - 2
        return 0 if t < 2 or (c, parent) not in users else 1 + level(c, parent)

    return {(c, t): level(c, t) for c, t in users}


def test_query_against_brute_force(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    out = chat.format_conversations(spark, "/root/testdata/sf0.01").collect()
    rows = turns.collect()
    assert len(out) >= sum(r["role"] == "user" for r in rows)
    got = {(r["conv_id"], r["turn"]): r["level"] for r in out if r["name"]}
    assert got == brute_query(rows)
    answers = {(r["conv_id"], r["turn"] - 1): r["text"] for r in rows if r["role"] == "assistant"}
    for r in out:
        if r["name"]:
            line = json.loads(r["line"])
            assert line.get("result") == answers.get((r["conv_id"], r["turn"])) and r["line"] == json.dumps(line, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            wrong = [e for e in r["errors"] if e != "no result" and not e.startswith("missing call")]
            a = line["arguments"]
            valid = {"search": isinstance(a.get("limit"), int) and "query" in a, "translate": a.get("to") in ("de", "en", "es", "fr") and "text" in a, "measure": "text" in a}[r["name"]]
            assert valid == (not wrong)
