"""Export files of assistants and tools as DataFrames of episodes.

Files are read by Spark; rows are files or records, and what a record says is taken apart with column expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKIPPED = ("file-history-snapshot", "queue-operation")  # fixed values: record types without content
CHUNK_BYTES = 4096

NODE = "struct<parent: string, message: struct<author: struct<role: string>, content: struct<parts: array<string>>, create_time: double>>"
TREE = f"title string, create_time double, current_node string, mapping map<string, {NODE}>"
FLAT = "uuid string, name string, created_at string, updated_at string, chat_messages array<struct<uuid: string, text: string, sender: string, created_at: string>>"
AUDIT = "Id string, CreationTime string, UserId string, Operation string, CopilotEventData string"


def whole_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """``path, content`` of every file below a folder."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def pack(lines: Iterable[tuple[str, str | None]], cap: int = CHUNK_BYTES) -> Iterator[tuple[str, str | None, int]]:
    """Greedy chunks of whole lines of at most ``cap`` bytes: text, time and lines.  A longer line stands alone.

    The time is the first one in the chunk, else the last one seen before it.
    """
    held: list[str] = []
    size, ts, last = 0, None, None
    for text, t in lines:
        n = len(text.encode())
        if held and size + 1 + n > cap:
            yield "\n".join(held), ts or last, len(held)
            held, size = [], 0
            last, ts = ts or last, None
        size += n + bool(held)
        held.append(text)
        ts = ts or t
    if held:
        yield "\n".join(held), ts or last, len(held)


def session_record(line: str) -> tuple[str, str | None] | None:
    """Type and time of a session record; None where the line is no record, that is lacks a string ``type`` or ``sessionId``."""
    try:
        r = json.loads(line)
    except ValueError:
        return None
    if not isinstance(r, dict) or not isinstance(r.get("type"), str) or not (r["type"] in SKIPPED or isinstance(r.get("sessionId"), str)):
        return None
    return r["type"], r.get("timestamp") if isinstance(r.get("timestamp"), str) else None


def session_chunks(spark: SparkSession, path: str, cap: int = CHUNK_BYTES) -> DataFrame:
    """``path, block, chunk, text, ts, records, problem`` of session logs (``*.jsonl`` at any depth).

    Logs are read by line, in splits; ``block`` is where a split begins in its file, and chunks are packed within it.  A line that is no record
    yields a row with ``problem`` and ends the file: its later lines and blocks are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string())
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["path", "block", "chunk", "text", "ts", "records", "problem"])
            out.clear()
            return b

        for (file, block), lines in groupby(rows, key=lambda r: (r[0], r[1])):
            problem = None

            def good() -> Iterator[tuple[str, str | None]]:
                nonlocal problem
                for i, (_, _, line) in enumerate(lines):
                    if not line.strip():
                        continue
                    if (r := session_record(line)) is None:
                        problem = f"line {i + 1} is no session record"
                        return
                    if r[0] not in SKIPPED:
                        yield line, r[1]

            for k, (text, ts, n) in enumerate(pack(good(), cap)):
                out.append((file, block, k, text, ts, n, None))
                if len(out) >= 1000:
                    yield flush()
            if problem:
                out.append((file, block, None, None, None, 0, problem))
        if out:
            yield flush()

    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    chunks = lines.mapInArrow(run, "path string, block bigint, chunk int, text string, ts string, records int, problem string")
    ended = chunks.filter("problem is not null").groupBy(F.col("path").alias("p")).agg(F.min("block").alias("last"))
    return chunks.join(ended, F.col("path") == F.col("p"), "left").filter("last is null or block <= last").drop("p", "last")


def text_chunks(documents: DataFrame, cap: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, chunk, text, lines`` of session texts in chunks of whole lines.  Null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(doc, k, chunk, n) for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) if text for k, (chunk, _, n) in enumerate(pack([(line, None) for line in text.split("\n")], cap))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.string(), pa.int32()))], names=["doc_id", "chunk", "text", "lines"])

    return documents.filter("doc_kind = 'session' and text is not null").select("doc_id", "text").mapInArrow(run, "doc_id bigint, chunk int, text string, lines int")


def tree_conversations(spark: SparkSession, path: str) -> DataFrame:
    """``title, create_time, state, messages`` of tree exports: the way from current_node up to the root, in time order.

    state is ok, missing (a node that is not there) or cycle; siblings off the way are left out.  Each conversation is walked once, by place.
    """
    df = spark.read.schema(TREE).option("multiLine", "true").json(path)
    nodes = F.map_values("mapping")
    flat = df.select("title", "create_time", "current_node", F.map_keys("mapping").alias("ids"), F.transform(nodes, lambda n: n["parent"]).alias("parents"), F.transform(nodes, lambda n: n["message"]).alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            states, ways = [], []
            for at, ids, parents in zip(*(b.column(c).to_pylist() for c in ("current_node", "ids", "parents"))):
                place = {k: i for i, k in enumerate(ids or [])}
                way, seen, state = [], set(), "ok"
                while at is not None and state == "ok":
                    i = place.get(at)
                    if i is None or i in seen:
                        state = "missing" if i is None else "cycle"
                    else:
                        way.append(i), seen.add(i)
                        at = parents[i]
                states.append(state), ways.append(way[::-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(states, pa.string()), pa.array(ways, pa.list_(pa.int32()))], names=[*b.schema.names, "state", "way"])

    walked = flat.mapInArrow(run, T.StructType([*flat.schema, T.StructField("state", T.StringType()), T.StructField("way", T.ArrayType(T.IntegerType()))]))
    return walked.select("title", "create_time", "state", F.filter(F.transform("way", lambda i: F.get("nodes", i)), lambda m: m.isNotNull()).alias("messages"))


def _stamp(seconds: Column) -> Column:
    return F.coalesce(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("unknown"))


def render_tree(conversations: DataFrame) -> DataFrame:
    """``title, content``: a header and one paragraph ``[time] role:`` with the text per message; system and empty messages are dropped."""
    body = lambda m: F.array_join(F.filter(F.coalesce(m["content"]["parts"], F.array().cast("array<string>")), lambda p: F.trim(p) != ""), "\n\n")
    kept = F.filter("messages", lambda m: (F.coalesce(m["author"]["role"], F.lit("")) != "system") & (body(m) != ""))
    line = lambda m: F.concat(F.lit("["), _stamp(m["create_time"]), F.lit("] "), F.coalesce(m["author"]["role"], F.lit("unknown")), F.lit(":\n"), body(m))
    return conversations.filter("state = 'ok'").select("title", F.concat(F.lit("# "), F.coalesce("title", F.lit("untitled")), F.lit("\n\n"), F.array_join(F.transform(kept, line), "\n\n")).alias("content"))


def flat_conversations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FLAT).option("multiLine", "true").json(path)


def render_flat(conversations: DataFrame) -> DataFrame:
    """``uuid, content`` of flat exports, messages in the order they stand in."""
    line = lambda m: F.concat(F.lit("["), F.coalesce(m["created_at"], F.lit("unknown")), F.lit("] "), F.coalesce(m["sender"], F.lit("unknown")), F.lit(":\n"), F.coalesce(m["text"], F.lit("")))
    kept = F.filter(F.coalesce("chat_messages", F.array().cast(FLAT.split("chat_messages ")[1])), lambda m: F.trim(F.coalesce(m["text"], F.lit(""))) != "")
    return conversations.select("uuid", F.concat(F.lit("# "), F.coalesce("name", F.lit("untitled")), F.lit("\n\n"), F.array_join(F.transform(kept, line), "\n\n")).alias("content"))


def audit_records(spark: SparkSession, path: str) -> DataFrame:
    """Audit exports: ``.jsonl`` with a record a line and ``.json`` with an array of records, at any depth."""
    read = spark.read.schema(AUDIT).option("recursiveFileLookup", "true")
    return read.option("pathGlobFilter", "*.jsonl").json(path).unionByName(read.option("pathGlobFilter", "*.json").option("multiLine", "true").json(path))


def render_audit(records: DataFrame) -> DataFrame:
    """``Id, content``: fixed header lines and the event data with its top keys sorted."""
    data = F.from_json("CopilotEventData", "map<string, string>")
    ordered = F.map_from_entries(F.array_sort(F.map_entries(data)))
    return records.select("Id", F.concat_ws("\n", F.concat(F.lit("id: "), "Id"), F.concat(F.lit("time: "), "CreationTime"), F.concat(F.lit("user: "), "UserId"), F.concat(F.lit("operation: "), "Operation"), F.to_json(ordered)).alias("content"))


def schema_violations(rows: DataFrame, json_col: str, required: dict[str, str], key: str) -> DataFrame:
    """``key, path, problem`` of required dotted paths that are missing or of another type (string, number, boolean, object, array)."""
    v = F.try_parse_json(json_col)
    kinds = {"string": "STRING", "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}
    checks = []
    for path, kind in required.items():
        found = F.schema_of_variant(F.try_variant_get(v, "$." + path, "variant"))
        checks.append(F.when(found.isNull() | (found == "VOID"), F.struct(F.lit(path).alias("path"), F.lit("missing").alias("problem"))).when(~found.rlike(f"^({kinds[kind]})"), F.struct(F.lit(path).alias("path"), F.concat(F.lit("is "), found).alias("problem"))))
    return rows.select(key, F.explode(F.array_compact(F.array(*checks))).alias("x")).select(key, "x.path", "x.problem")


def markdown_seeds(spark: SparkSession, path: str, namespace: str) -> DataFrame:
    """Markdown files as episodes of one namespace; the event id is 'seed:' and the path below the folder, so equal names in two folders differ."""
    df = whole_files(spark, path, "*.{md,markdown}")
    below = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/"), "^" + re.escape("/" + path.split(":", 1)[-1].strip("/")) + "/+", "")
    return df.select(F.lit("manual").alias("source"), F.concat(F.lit("seed:"), below).alias("source_event_id"), "content", F.lit(namespace).alias("namespace"), F.lit("user_authored_seed").alias("ingestion_mode"), F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))


def webhook_episodes(events: DataFrame) -> DataFrame:
    """Webhook rows (event, body) as episodes: comments on issues and reviews only; others, and blank comments, are not episodes."""
    get = lambda p: F.get_json_object("body", "$." + p)
    kept = events.filter(F.col("event").isin("issue_comment", "pull_request_review_comment")).filter(get("comment.id").isNotNull() & (F.trim(F.coalesce(get("comment.body"), F.lit(""))) != ""))
    meta = F.to_json(F.struct(F.col("event").alias("event"), get("action").alias("action"), get("comment.html_url").alias("url")))
    return kept.select(
        F.lit("github").alias("source"), F.concat_ws(":", "event", get("comment.id")).alias("source_event_id"), get("comment.body").alias("content"), get("repository.full_name").alias("namespace"),
        F.array_compact(F.array(get("sender.login"))).alias("participants"), F.lit("live_mcp_capture").alias("ingestion_mode"), meta.alias("metadata"), F.try_to_timestamp(get("comment.created_at")).alias("occurred_at"))


def learn_requests(requests: DataFrame, mode: str | None = None, source: str | None = None) -> DataFrame:
    """Requests (content, source, namespace, ingestion_mode, parser_version, parser_source_schema) as episodes.

    ``mode`` and ``source`` force theirs; a forced mode empties the parser fields.  Blank content or namespace is refused (left out).
    """
    rows = requests.filter((F.trim(F.coalesce("content", F.lit(""))) != "") & (F.trim(F.coalesce("namespace", F.lit(""))) != ""))
    if mode:
        rows = rows.withColumn("ingestion_mode", F.lit(mode)).withColumn("parser_version", F.lit(None).cast("string")).withColumn("parser_source_schema", F.lit(None).cast("string"))
    if source:
        rows = rows.withColumn("source", F.lit(source))
    return rows.withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))
