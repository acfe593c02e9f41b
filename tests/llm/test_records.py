"""WARC round trips, tool calls, oracles and the pipeline."""

import gzip
import hashlib
import json
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import bwt_dedup, decontam, durable, jaccard_join, registry, toolcalls, warc
from tests.llm import cases
from tests.llm.test_documents import components, contaminated, expected_cuts

SF = "/root/testdata/sf0.001"


def pages(spark):
    rng = random.Random(2)
    body = lambda n: "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0x100, 0x2000)])) for _ in range(n))
    rows = [(i, f"http://h/{i}", body(rng.choice([0, 5, 99, 300, 2000]))) for i in range(120)]
    rows += [(200 + i, "http://copy\r\nX: y", rows[3][2] + "z" * 200) for i in range(6)] + [(150, None, rows[3][2] + "z" * 200), (300, "u", None), (301, None, ""), (302, "u", "s" * 99), (303, "u", "s" * 99), (304, "u", "t" * 100), (305, "u", "t" * 100)]
    rows += [(304, "again", "t" * 100), (None, "u", "t" * 100), (None, "v", "n" * 150), (400, "big", "q" * 300_000), (401, "crlf", "a\r\n\r\nb" * 40)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def expected(rows):
    first = {}
    for p, _, h in rows:
        if h is not None and len(h.encode()) >= 100 and p is not None:
            first[h] = min(first.get(h, p), p)
    count = {}
    for _, _, h in rows:
        count[h] = count.get(h, 0) + 1
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        to = first.get(h) if h is not None and p != first.get(h) and count[h] > 1 else None
        out.append((p, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_warc_files_with_the_usual_name(spark, tmp_path):
    """Members of ordinary writers, in files named .warc.gz, with small splits."""
    import gzip

    want = []
    for n in range(3):
        out = b""
        for i in range(40):
            body = (b"%d-%d " % (n, i)) * (i * 37 % 300 + 1) + warc.MAGIC * (i % 3)
            head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r{n}-{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode()
            out += gzip.compress(head + body + b"\r\n\r\n", compresslevel=i % 10)
            want.append((f"r{n}-{i}", body))
        (tmp_path / f"part-{n}.warc.gz").write_bytes(out)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in (old, "700b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            found = warc.read(spark, str(tmp_path))
            assert sorted((r["record_id"], bytes(r["payload"])) for r in found.collect()) == sorted(want)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("split", ["134217728", "4000", "700"])
def test_warc_round_trip(spark, split):
    rows, frame = pages(spark)
    path = durable.new_path(spark, "warc-test")
    warc.write(frame, path, id_col="page_id")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        found = warc.read(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    number = lambda x: None if x is None or x == warc.URN else int(x.removeprefix(warc.URN))
    got = sorted(((number(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"])) for r in found), key=str)
    assert got == expected(rows)
    whole = {r["record_id"]: bytes(r["payload"]) for r in found if r["record_type"] == "response"}
    assert all(whole[f"{warc.URN}{p}"].decode() == (h or "") for p, _, h in rows if p is not None and f"{warc.URN}{p}" in whole)
    local = path.removeprefix("file:")
    for name in os.listdir(local):  # the files are plain gzip too
        if name.startswith("part-"):
            with open(f"{local}/{name}", "rb") as f:
                gzip.decompress(f.read())


def test_magic_inside_records(spark, tmp_path):
    """Members that are stored, not deflated, so that their content's magic stands in the file, cut into many ranges."""
    import zlib

    out, want = b"junk before", []
    for i in range(40):
        body = (b"x" * (i * 13 % 97) + warc.MAGIC + b"\x00" * 7) * (i % 5 + 1)
        record = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:r:{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)
        out += packer.compress(record) + packer.flush()
        want.append((f"urn:r:{i}", body))
    out += gzip.compress(b"not a record")
    (tmp_path / "a.warc.gz.bin").write_bytes(out)
    for split in ("100000", "997", "300"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = sorted((r["record_id"], bytes(r["payload"])) for r in warc.read(spark, str(tmp_path)).collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == sorted(want), split


def test_empty_archive(spark):
    path = durable.new_path(spark, "warc-none")
    warc.write(pages(spark)[1].limit(0), path)
    assert warc.read(spark, path).count() == 0


SCHEMAS = {"add": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["string", "null"]}, "c": {"enum": [1, 2]}, "d": {"type": "array", "items": {"type": "number"}}}}}


def call(i, **arguments):
    return {"id": i, "name": "add", "arguments": arguments}


def test_tool_calls(spark):
    say = lambda *calls, **more: json.dumps({"tool_calls": list(calls), **more})
    answer = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    rows = [
        (1, 0, "user", "hé \"q\""), (1, 1, "assistant", say(call("x", a=1), content="go")), (1, 2, "tool", answer("x", {"b": 1, "a": 2})), (1, 3, "assistant", None),
        # a result before its call, and a call before the result it refers to
        (2, 0, "tool", answer("p", "early")), (2, 1, "assistant", say(call("q", a={"$ref": "p"}))), (2, 2, "assistant", say({"id": "p", "function": {"name": "add", "arguments": "{\"a\": 4}"}})), (2, 3, "tool", answer("q", "late")),
        # wrong arguments, no result, no call, an identifier used twice
        (3, 0, "assistant", say(call("m", a=-1, z=0, c=3, d=[1, "x"]), call("n"), {"id": "u", "name": "other", "arguments": {}}, {"name": "add", "arguments": "{"})), (3, 1, "tool", answer("gone", 1)), (3, 2, "assistant", say(call("n", a=2))),
        # a cycle
        (4, 0, "assistant", say(call("f", a={"$ref": "g"}))), (4, 1, "tool", answer("f", 1)), (4, 2, "assistant", say(call("g", a={"$ref": "f"}))), (4, 3, "tool", answer("g", 1)),
        (5, 0, "user", "{not json"), (5, 0, "user", "{\"other\": 1}"), (5, None, "user", ""), (None, 3, None, "x"), (6, 1, "user", "{" * 3000),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("seq", F.lit("clash"))
    got = toolcalls.link(frame, SCHEMAS).collect()
    assert len(got) == len(rows)
    order = lambda c: [r["turn"] for r in sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["seq"])]
    assert order(1) == [0, 1, 2, 3] and order(2) == [2, 0, 1, 3] and order(4) == [0, 1, 2, 3]
    message = {(r["conv_id"], r["turn"]): r["message"] for r in got}
    assert message[1, 0] == '{"content":"hé \\"q\\"","role":"user"}' and message[1, 3] == '{"content":null,"role":"assistant"}'
    assert message[1, 1] == '{"content":"go","role":"assistant","tool_calls":[{"arguments":{"a":1},"id":"x","name":"add"}]}'
    assert message[1, 2] == '{"content":{"a":2,"b":1},"role":"tool","tool_call_id":"x"}'
    assert message[2, 2] == '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"a":4},"id":"p","name":"add"}]}'
    problems = {(r["conv_id"], r["turn"]): set(r["problems"]) for r in got}
    assert problems[1, 1] == set() and problems[2, 1] == set()
    assert {"m: /a: out of range", "m: /z: unknown", "m: /c: not in enum", "m: /d/1: not number", "n: /a: missing", "u: unknown tool other", "call without id", "None: arguments are not JSON", "m: no result", "n: no result", "u: no result"} == problems[3, 0]
    assert problems[3, 1] == {"gone: no call"} and problems[3, 2] == {"n: used before"}
    assert all(problems[4, t] == {"references in a cycle"} for t in range(4))
    assert toolcalls.link(frame.limit(0)).count() == 0


def test_query_validates_by_declared_tools(spark, tmp_path):
    tools = json.dumps({"tools": [{"type": "function", "function": {"name": "add", "parameters": SCHEMAS["add"]}}]})
    rows = [(1, 0, "system", tools), (1, 1, "assistant", json.dumps({"tool_calls": [call("m", a=-1), {"id": "u", "name": "other"}]})), (2, 0, "assistant", json.dumps({"tool_calls": [call("m", a=-1)]}))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): r["problems"] for r in toolcalls.op8_toolcalls(spark, str(tmp_path)).collect()}
    assert got == {(1, 0): "", (1, 1): "m: /a: out of range; m: no result; u: no result; u: unknown tool other", (2, 0): "m: no result"}


def test_declared_schemas_that_cannot_be_read():
    message = json.dumps({"tool_calls": [call("m", a=1)]})
    for schema in ({"type": 5}, {"enum": 1}, {"required": 3}, {"properties": {"a": 1}}):
        assert toolcalls._against(message, 1, [{"turn": 0, "name": "add", "schema": json.dumps(schema)}]) == ["m: schema of add cannot be read"]
    assert toolcalls.offered('{"tools": [1, {"name": "f"}]}') == [("f", "{}")] and toolcalls.offered('{"tools": 3}') == toolcalls.offered(None) == []


def test_tool_calls_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 12)):
            ids = [rng.choice("abcdef") for _ in range(rng.randint(1, 2))]
            if rng.random() < 0.5:
                text = json.dumps({"tool_calls": [{"id": i, "name": "f", "arguments": {"x": {"$ref": rng.choice("abcdef")}} if rng.random() < 0.4 else {}} for i in ids]})
            else:
                text = json.dumps({"tool_call_id": ids[0], "content": t})
            rows.append((c, t, "any", text))
    got = {(r["conv_id"], r["turn"]): r for r in toolcalls.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()}
    assert len(got) == len(rows)
    for c in {r[0] for r in rows}:
        turns = {t: json.loads(x) for k, t, _, x in rows if k == c}
        called, answered = {}, {}
        for t in sorted(turns):
            for call in turns[t].get("tool_calls", ()):
                called.setdefault(call["id"], t)
            if "tool_call_id" in turns[t]:
                answered.setdefault(turns[t]["tool_call_id"], t)
        want, edges = {t: set() for t in turns}, set()
        for t, body in turns.items():
            for call in body.get("tool_calls", ()):
                if call["id"] not in answered:
                    want[called[call["id"]]].add(f"{call['id']}: no result")
                if called[call["id"]] < t:
                    want[t].add(f"{call['id']}: used before")
                ref = call["arguments"].get("x", {}).get("$ref")
                if ref in called and ref in answered:
                    edges.add((answered[ref], t))
            i = body.get("tool_call_id")
            if i is not None and i not in called:
                want[t].add(f"{i}: no call")
            elif i is not None:
                edges.add((called[i], t))
        before = {t: {a for a, b in edges if b == t} for t in turns}
        for _ in turns:
            before = {t: s.union(*(before[a] for a in s)) for t, s in before.items()}
        behind = {t for t in turns if any(a in before[a] for a in before[t])}
        for t in behind:
            want[t].add("references in a cycle")
        assert {t: set(got[c, t]["problems"]) for t in turns} == want
        seq = {t: got[c, t]["seq"] for t in turns}
        assert sorted(seq.values()) == list(range(len(turns)))
        assert all(seq[a] < seq[b] for a, b in edges if b not in behind)
        if all(a < b for a, b in edges):
            assert sorted(turns, key=seq.get) == sorted(turns)


def test_oracles(spark):
    duck = duckdb.connect()
    for name in os.listdir(SF):
        duck.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    for name, sql in registry.oracle_sql().items():
        frame = registry.queries()[name](spark, SF)
        columns = sorted(frame.columns)
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str) == sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=str), name


def test_pipeline_against_brute_force(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = durable.settle(corpus_pipeline.language(spark, docs, SF), "p0")
    assert kept.columns == columns and kept.count() >= 0.98 * docs.count()
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    near = durable.settle(corpus_pipeline.near_duplicates(spark, kept, SF), "p1")
    assert near.columns == columns and sorted(r["doc_id"] for r in near.collect()) == sorted({c for _, _, c in components(rows, 5, 80)})
    cut = durable.settle(corpus_pipeline.repeated_strings(spark, near, SF), "p2")
    rows = [(r["doc_id"], r["text"]) for r in near.collect()]
    want = {d: w for (d, _), w in zip(rows, expected_cuts([t for _, t in rows], 200))}
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert cut.columns == columns and set(got) == {d for d, w in want.items() if w[1] < w[0]}
    assert all(hashlib.sha256(t.encode()).hexdigest() == want[d][3] for d, t in got.items() if want[d][1] == 0)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = durable.settle(corpus_pipeline.decontaminated(spark, cut, SF), "p3")
    bad = {d for d, t in got.items() if (x := contaminated(t, items))[1] > 0 and 20 * x[1] >= x[0]}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == set(got) - bad
    last = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in last.collect()} == set(got) - bad and all(r["taken"] <= 2 * r["size"] for r in last.collect())


def test_stages_take_awkward_tables(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [r[:5] for r in cases.documents(n=20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame, stages in ((docs, corpus_pipeline.STAGES[1:]), (docs, corpus_pipeline.STAGES), (docs.limit(0), corpus_pipeline.STAGES)):
        now = frame
        for _, stage in stages:
            now = durable.settle(stage(spark, now, SF), "awkward")
        assert now.count() <= frame.count()
    extra = docs.withColumn("score", F.lit(1)).withColumn("row", F.lit("clash"))
    kept = corpus_pipeline.language(spark, extra, SF)
    assert kept.columns == extra.columns and all(any(c.isalpha() for c in r["text"] or "") for r in kept.collect())
    assert {r["doc_id"] for r in jaccard_join.keep_one(docs).collect()} <= {r[0] for r in rows}
    assert bwt_dedup.dedup(docs).count() == len(rows)
    assert decontam.remove(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).columns == docs.columns
