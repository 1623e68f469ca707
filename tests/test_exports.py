from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.sources import exports as ex
from tidemark.sources.tables import table
from tests.conftest import SF


def test_session_chunks(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    rec = lambda i, ts=None, **x: json.dumps({"type": "user", "sessionId": "s", "n": i, **({"timestamp": ts} if ts else {}), **x})
    lines = [rec(0), rec(1, "t1"), json.dumps({"type": "queue-operation"}), rec(2, "t2"), rec(3, pad="é" * 60), rec(4)]
    (tmp_path / "a" / "b" / "x.jsonl").write_text("\n".join(lines) + "\n\n", encoding="utf-8")
    (tmp_path / "bad.jsonl").write_text(rec(0) + "\n{oops\n" + rec(1))
    rows = ex.session_chunks(spark, str(tmp_path), cap=120).orderBy("path", "chunk").collect()
    good = [r for r in rows if r["path"].endswith("x.jsonl")]
    assert [r["records"] for r in good] == [2, 1, 1, 1] and [r["ts"] for r in good] == ["t1", "t2", "t2", "t2"]
    assert "\n".join(r["text"] for r in good).split("\n") == [line for i, line in enumerate(lines) if i != 2]
    assert all(len(r["text"].encode()) <= 120 or r["records"] == 1 for r in good)
    bad = [r for r in rows if r["path"].endswith("bad.jsonl")]
    assert sum(r["problem"] is not None for r in bad) == 1 and sum(r["text"] is not None for r in bad) == 1


def test_long_logs_are_read_in_splits(spark, tmp_path):
    rec = lambda i: json.dumps({"type": "user", "sessionId": "s", "n": i, "pad": "x" * (i % 50)})
    lines = [rec(i) for i in range(3000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text("\n".join([*lines[:100], "{", *lines]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        rows = ex.session_chunks(spark, str(tmp_path), cap=500).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    good = sorted((r for r in rows if r["path"].endswith("a.jsonl")), key=lambda r: (r["block"], r["chunk"]))
    assert len({r["block"] for r in good}) > 3 and "\n".join(r["text"] for r in good) == "\n".join(lines) and max(len(r["text"]) for r in good) <= 500
    bad = [r for r in rows if r["path"].endswith("b.jsonl")]
    assert sum(r["records"] for r in bad) == 100 and sum(r["problem"] is not None for r in bad) == 1


def test_text_chunks_give_the_text_back(spark):
    docs = table(spark, SF, "documents")
    back = ex.text_chunks(docs, 700).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]), "\n").alias("t"), F.max(F.octet_length("text")).alias("most"))
    bad = back.join(docs, "doc_id").filter("t <> text").count()
    assert bad == 0 and back.count() == docs.filter("doc_kind = 'session' and length(text) > 0").count()


def node(parent, role=None, parts=None, at=0.0):
    return {"parent": parent, "message": None if role is None else {"author": {"role": role}, "content": {"parts": parts}, "create_time": at}}


def test_tree_exports(spark, tmp_path):
    ok = {"title": "T", "create_time": 1.0, "current_node": "c", "mapping": {"r": node(None), "s": node("r", "system", ["x"]), "a": node("s", "user", ["hi", " "], 60.0), "z": node("s", "user", ["sibling"]), "b": node("a", "assistant", [""]), "c": node("b", "assistant", ["yo", "ho"], 61.0)}}
    cyc = {"title": "C", "current_node": "a", "mapping": {"a": node("b", "user", ["1"]), "b": node("a", "user", ["2"])}}
    gone = {"title": "M", "current_node": "a", "mapping": {"a": node("q", "user", ["1"])}}
    (tmp_path / "e.json").write_text(json.dumps([ok, cyc, gone]))
    df = ex.tree_conversations(spark, str(tmp_path))
    assert {r["title"]: r["state"] for r in df.collect()} == {"T": "ok", "C": "cycle", "M": "missing"}
    got = ex.render_tree(df).collect()
    assert [r["content"] for r in got] == ["# T\n\n[1970-01-01T00:01:00] user:\nhi\n\n[1970-01-01T00:01:01] assistant:\nyo\n\nho"]


def test_tree_exports_longer_than_ten_thousand(spark, tmp_path):
    n = 40_020
    long = {"title": "L", "current_node": f"k{n - 1}", "mapping": {f"k{i}": node(f"k{i - 1}" if i else None, "user", [str(i)]) for i in range(n)}}
    none = {"title": "N", "current_node": None, "mapping": None}
    (tmp_path / "e.json").write_text(json.dumps([long, none]))
    got = {r["title"]: r for r in ex.tree_conversations(spark, str(tmp_path)).collect()}
    assert got["L"]["state"] == "ok" and [m["content"]["parts"][0] for m in got["L"]["messages"]] == [str(i) for i in range(n)]
    assert got["N"]["state"] == "ok" and got["N"]["messages"] == []


def test_flat_and_audit_exports(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "c.json").write_text(json.dumps([{"uuid": "u", "name": "N", "chat_messages": [{"text": "a", "sender": "human", "created_at": "t"}, {"text": " "}]}, {"uuid": "v"}]))
    got = {r["uuid"]: r["content"] for r in ex.render_flat(ex.flat_conversations(spark, str(tmp_path / "f"))).collect()}
    assert got == {"u": "# N\n\n[t] human:\na", "v": "# untitled\n\n"}
    (tmp_path / "d").mkdir()
    one = {"Id": "1", "CreationTime": "t", "UserId": "u", "Operation": "op", "CopilotEventData": {"b": 1, "a": "x"}}
    (tmp_path / "d" / "a.jsonl").write_text(json.dumps(one))
    (tmp_path / "d" / "b.json").write_text(json.dumps([one | {"Id": "2"}]))
    rows = {r["Id"]: r["content"] for r in ex.render_audit(ex.audit_records(spark, str(tmp_path / "d"))).collect()}
    assert rows["1"] == 'id: 1\ntime: t\nuser: u\noperation: op\n{"a":"x","b":"1"}' and set(rows) == {"1", "2"}


def test_schema_violations(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": "x"}, "n": 2, "l": []}'), (2, '{"a": {"b": 3}, "l": {}}'), (3, "no json"), (4, None)], "id int, j string")
    got = sorted(tuple(r)[:2] for r in ex.schema_violations(df, "j", {"a.b": "string", "n": "number", "l": "array"}, "id").collect())
    assert got == [(2, "a.b"), (2, "l"), (2, "n"), *[(i, p) for i in (3, 4) for p in ("a.b", "l", "n")]]


def test_seeds_webhooks_and_requests(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "n.md").write_text("# hi")
    (tmp_path / "x" / "n.txt").write_text("no")
    (tmp_path / "y" / "z").mkdir(parents=True)
    (tmp_path / "y" / "z" / "n.md").write_text("# ho")
    assert sorted((r["source_event_id"], r["content"]) for r in ex.markdown_seeds(spark, str(tmp_path), "ns").collect()) == [("seed:x/n.md", "# hi"), ("seed:y/z/n.md", "# ho")]
    body = json.dumps({"comment": {"id": 7, "body": "c"}, "repository": {"full_name": "o/r"}, "sender": {"login": "l"}})
    ev = spark.createDataFrame([("issue_comment", body), ("push", body), ("issue_comment", "{}"), ("issue_comment", body.replace('"c"', '" "'))], "event string, body string")
    assert [tuple(r)[1:5] for r in ex.webhook_episodes(ev).collect()] == [("issue_comment:7", "c", "o/r", ["l"])]
    rq = spark.createDataFrame([("c", "s", "n", "vendor_import", "1", "2"), (" ", "s", "n", None, None, None), ("c", "s", None, None, None, None)], "content string, source string, namespace string, ingestion_mode string, parser_version string, parser_source_schema string")
    assert [tuple(r)[1:6] for r in ex.learn_requests(rq, "live_mcp_capture", "manual").collect()] == [("manual", "n", "live_mcp_capture", None, None)]
