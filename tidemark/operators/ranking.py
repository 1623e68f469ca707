"""Scoring, weighting, budgets and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.common import latest, live, once
from tidemark.operators.memory import COEFFICIENTS, MODES, best_mode, facts_once, rows_as
from tidemark.operators.retrieval import AS_OF

# Authority of an evidence status, weights of a task class for (episodic, semantic, procedural), tokens of an item.
AUTHORITY = {"user_asserted": 1.0, "observed": 0.8, "promoted": 0.7, "extracted": 0.6, "inferred": 0.4, "deprecated": 0.2, "superseded": 0.1}
WEIGHTS = {"debug": (1.0, 0.7, 0.8), "architecture": (0.5, 1.0, 0.3), "compliance": (1.0, 0.8, 0.0), "writing": (0.3, 1.0, 0.6), "chat": (0.4, 1.0, 0.3)}
ITEM_TOKENS = {"fact": 50, "graph": 30, "procedure": 40, "episode": 100}
KEYWORDS = {  # fixed values, in order of priority
    "debug": ["error", "bug", "crash", "fail", "exception", "stack trace", "debug", "troubleshoot", "broken", "fix"],
    "architecture": ["architecture", "design", "component", "system", "diagram", "module", "structure", "pattern", "microservice"],
    "compliance": ["compliance", "audit", "regulation", "policy", "governance", "control", "evidence", "finding", "risk"],
    "writing": ["write", "document", "draft", "generate", "create doc", "readme", "specification"],
}
ITEMS = "array<struct<type: string, score: double>>"


def _map(values: dict, key: Column, default: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key], F.lit(default))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def fact_scores(facts: DataFrame, episodes: DataFrame) -> DataFrame:
    """``id, relevance, stability, provenance, final`` of every live fact.

    relevance: the confidence in its properties, 0.5 without; recency 0.6; stability (0.5 if current, else 0.1) + 0.3 authority + 0.1; provenance
    (0.5 min(sources / 5, 1) + 0.5 authority) times the coefficient of its best ingestion mode; final 0.40, 0.25, 0.20 and 0.15 of these.
    """
    f = facts_once(facts, "valid_until", "evidence_status", "source_episodes", "properties")
    rows = f.join(best_mode(facts, episodes), "id", "left")
    a = _map(AUTHORITY, F.col("evidence_status"), 0.5)
    n = F.size(F.coalesce("source_episodes", F.array().cast("array<string>")))
    coefficient = _map(dict(zip(MODES, COEFFICIENTS)), F.coalesce("mode", F.lit("")), 1.0)
    rows = rows.select(
        "id", clamp(F.coalesce(F.get_json_object("properties", "$.confidence").cast("double"), F.lit(0.5))).alias("relevance"),
        clamp(F.when(F.col("valid_until").isNull(), 0.5).otherwise(0.1) + 0.3 * a + 0.1).alias("stability"),
        clamp((0.5 * F.least(n / 5.0, F.lit(1.0)) + 0.5 * a) * coefficient).alias("provenance"))
    final = 0.40 * F.col("relevance") + 0.25 * 0.6 + 0.20 * F.col("stability") + 0.15 * F.col("provenance")
    return rows.select("id", *[F.round(c, 5).alias(c) for c in ("relevance", "stability", "provenance")], F.round(final, 5).alias("final"))


def items(log: DataFrame) -> DataFrame:
    """``id, primary_class, budget, pos, type, score`` of every candidate of a compilation, selected ones first."""
    rows = once(log.select("id", "primary_class", "compiled_tokens", "selected_items", "rejected_items"))
    none = F.array().cast(ITEMS)
    all_ = F.concat(F.coalesce(F.from_json("selected_items", ITEMS), none), F.coalesce(F.from_json("rejected_items", ITEMS), none))
    return rows.select("id", "primary_class", "compiled_tokens", all_.alias("items"))


def _weight(kind: Column, cls: Column) -> Column:
    pick = lambda i: _map({k: v[i] for k, v in WEIGHTS.items()}, cls, 1.0)
    return F.when(kind == "episode", pick(0)).when(kind == "procedure", pick(2)).otherwise(pick(1))


def apply_weights(log: DataFrame) -> DataFrame:
    """Per class and type: candidates, those dropped for weight 0 and the mean weighted score of the others."""
    rows = items(log).select("primary_class", F.explode("items").alias("i")).select("primary_class", "i.type", F.col("i.score").alias("score"))
    w = _weight(F.col("type"), F.col("primary_class"))
    return rows.groupBy("primary_class", "type").agg(rows_as("candidates"), F.count(F.when(w == 0, 1)).alias("dropped"), F.round(F.avg(F.when(w > 0, F.col("score") * w)), 5).alias("mean_weighted"))


def greedy_pack(log: DataFrame, share: float = 0.25) -> DataFrame:
    """``id, kept, tokens, skipped``: candidates of each compilation in order of score (ties by position), kept while they fit ``share`` of
    its tokens; one that does not fit is skipped and later, smaller ones may still be kept.  A fold over one row's short list."""
    cost = lambda k: F.coalesce(*[F.when(k == t, n) for t, n in ITEM_TOKENS.items()], F.lit(ITEM_TOKENS["episode"]))
    ranked = F.array_sort(F.transform("items", lambda x, i: F.struct((-x["score"]).alias("s"), i.alias("i"), x["type"].alias("t"))))
    start = F.struct(F.lit(0).alias("kept"), F.lit(0).alias("tokens"), F.lit(0).alias("skipped"))
    step = lambda acc, x: F.when(acc["tokens"] + cost(x["t"]) <= F.col("budget"), F.struct((acc["kept"] + 1).alias("kept"), (acc["tokens"] + cost(x["t"])).alias("tokens"), acc["skipped"].alias("skipped"))).otherwise(F.struct(acc["kept"].alias("kept"), acc["tokens"].alias("tokens"), (acc["skipped"] + 1).alias("skipped")))
    rows = items(log).filter(F.size("items") > 0).withColumn("budget", F.floor(F.col("compiled_tokens") * share)).withColumn("r", F.aggregate(ranked, start, step))
    return rows.select("id", "r.kept", "r.tokens", "r.skipped")


def classify(log: DataFrame) -> DataFrame:
    """Keyword pre-check of every query: the first group, by priority, one of whose words it contains, against the class it got; none: null."""
    rows = once(log.select("id", "query_text", "primary_class"))
    low = F.lower("query_text")
    guess = F.coalesce(*[F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(k)) for k, words in KEYWORDS.items()])
    return rows.groupBy(guess.alias("guess"), "primary_class").agg(rows_as("n"))


def parse_classes(log: DataFrame) -> DataFrame:
    """What the confidences say: below 0.1 the class is chat; a second class stays only within 0.3 of the first."""
    rows = once(log.select("id", "primary_class", "secondary_class", "primary_confidence", "secondary_confidence"))
    c1 = F.coalesce("primary_confidence", F.lit(0.0))
    first = F.when(c1 < 0.1, "chat").otherwise(F.col("primary_class"))
    second = F.when((c1 >= 0.1) & (F.round(c1 - F.col("secondary_confidence"), 6) < 0.3), F.col("secondary_class"))
    return rows.groupBy(first.alias("first"), F.coalesce(second, F.lit("none")).alias("second")).agg(rows_as("n"))


def salience(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """``entity_id, namespace, accesses, salience``: every fact about an entity is an access; 0.5 moves to 1 as 1 - 0.5 * 0.9**n.

    Entities without id are left out.
    """
    f = facts_once(facts, "subject_id", "object_id")
    n = f.select(F.explode(F.array("subject_id", "object_id")).alias("entity_id")).groupBy("entity_id").agg(rows_as("accesses"))
    ids = once(live(entities).select("id", "namespace").filter("id is not null")).select(F.lower("id").alias("entity_id"), "namespace")
    rows = ids.join(n, "entity_id", "left").fillna(0, ["accesses"])
    return rows.withColumn("salience", F.round(1 - 0.5 * F.pow(F.lit(0.9), F.col("accesses")), 6))


def budget_overflow(facts: DataFrame, entities: DataFrame, budget: int = 500, tokens: int = 20) -> DataFrame:
    """``entity_id, namespace``: entities to demote so that a namespace's tokens come down to the budget, least salient first (ties by id).

    A running sum from the most salient on: what begins beyond the budget goes.  As all entities cost the same, the budget keeps at most
    budget / tokens of a namespace, so Spark needs only the first ranks; the rest is an anti-join and no namespace is sorted in one task.
    """
    rows = salience(facts, entities)
    keep = latest(rows, ["namespace"], [F.desc("salience"), F.desc("entity_id")], budget // tokens).select("entity_id")
    return rows.join(keep, "entity_id", "left_anti").select("entity_id", "namespace")


def hot_snapshot(facts: DataFrame, entities: DataFrame, most: int = 10) -> DataFrame:
    """Per namespace its most salient entities as JSON, with their tokens."""
    top = latest(salience(facts, entities), ["namespace"], [F.desc("accesses"), F.asc("entity_id")], most)
    rows = top.groupBy("namespace").agg(F.array_sort(F.collect_list(F.struct("rank", "entity_id", "accesses"))).alias("x"))
    return rows.select("namespace", F.to_json(F.transform("x", lambda e: F.struct(e["entity_id"].alias("id"), e["accesses"].alias("n")))).alias("entities"), (F.size("x") * 20).alias("tokens"))


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def newest_named(facts: DataFrame, entities: DataFrame, most: int) -> DataFrame:
    """The newest current facts of each subject with the names of both ends; facts whose ends are missing or deleted take no rank."""
    n = once(live(entities).select("id", "name")).select(F.lower("id").alias("e"), F.coalesce("name", F.lit("")).alias("name"))
    f = facts_once(facts, "subject_id", "predicate", "object_id", "valid_until", "valid_from").filter("valid_until is null").drop("valid_until")
    f = f.join(n.select(F.col("e").alias("subject_id")), "subject_id", "left_semi").join(n.select(F.col("e").alias("object_id")), "object_id", "left_semi")
    top = latest(f, ["subject_id"], [F.desc_nulls_last("valid_from"), F.asc("id")], most)
    return top.join(n.toDF("subject_id", "subject"), "subject_id").join(n.toDF("object_id", "object"), "object_id")


def compile_structured(facts: DataFrame, entities: DataFrame, most: int = 20) -> DataFrame:
    """``entity_id, context, tokens``: for every entity with current facts, the newest of them as one element each, newest first.

    Only ``most`` facts per entity are gathered; the rank is taken before they are.  Null names, predicates and times are empty."""
    rows = newest_named(facts, entities, most)
    line = F.concat(F.lit('  <fact subject="'), xml_escape(F.col("subject")), F.lit('" predicate="'), xml_escape(F.coalesce("predicate", F.lit(""))), F.lit('" object="'), xml_escape(F.col("object")), F.lit('" since="'), F.coalesce(F.date_format("valid_from", "yyyy-MM-dd"), F.lit("")), F.lit('"/>'))
    body = rows.groupBy("subject_id", "subject").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    context = F.concat(F.lit('<knowledge of="'), xml_escape(F.col("subject")), F.lit('">\n'), F.array_join(F.transform("x", lambda r: r["line"]), "\n"), F.lit("\n</knowledge>"))
    return body.select(F.col("subject_id").alias("entity_id"), context.alias("context")).withColumn("tokens", F.greatest(F.lit(1), F.floor(F.octet_length("context") / 4).cast("int")))


def compile_compact(facts: DataFrame, entities: DataFrame, most: int = 20) -> DataFrame:
    """The same as JSON lines {s, p, o}, one text per entity."""
    rows = newest_named(facts, entities, most)
    one = F.to_json(F.struct(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o")))
    out = rows.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("line")))).alias("x"))
    return out.select(F.col("subject_id").alias("entity_id"), F.concat(F.lit("["), F.array_join(F.transform("x", lambda r: r["line"]), ","), F.lit("]")).alias("context"))


def freshness(episodes: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Per namespace and source the time since the last ingestion: fresh (a day), aging (a week), stale, and in words (the date beyond a year)."""
    last = live(episodes).groupBy("namespace", "source").agg(F.max("ingested_at").alias("t"))
    secs = F.greatest(F.lit(0), F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("t").cast("timestamp")))
    rows = last.withColumn("s", secs)
    n = lambda unit: F.floor(F.col("s") / unit).cast("string")
    day = 86400
    word = (
        F.when(F.col("s") < 60, "just now").when(F.col("s") < 3600, F.concat(n(60), F.lit("m ago"))).when(F.col("s") < day, F.concat(n(3600), F.lit("h ago")))
        .when(F.col("s") < 7 * day, F.concat(n(day), F.lit("d ago"))).when(F.col("s") < 60 * day, F.concat(n(7 * day), F.lit(" weeks ago")))
        .when(F.col("s") < 365 * day, F.concat(n(30 * day), F.lit(" months ago"))).otherwise(F.date_format("t", "yyyy-MM-dd"))
    )
    return rows.select("namespace", "source", F.when(F.col("s") <= 86400, "fresh").when(F.col("s") <= 7 * 86400, "aging").otherwise("stale").alias("freshness"), word.alias("age"))


def latency_levels(log: DataFrame, warn: int = 500, critical: int = 1000) -> DataFrame:
    """Per namespace, compilations by level of their measured latency."""
    rows = once(log.filter("latency_total_ms >= 0").select("id", "namespace", "latency_total_ms"))
    level = F.when(F.col("latency_total_ms") >= critical, "critical").when(F.col("latency_total_ms") >= warn, "warn").otherwise("ok")
    return rows.groupBy("namespace", level.alias("level")).agg(rows_as("n"))


def entity_match(items_: DataFrame) -> DataFrame:
    """Per evaluation item the share of its expected names that its query or passage contains, without case; 0 when none is expected."""
    text = F.lower(F.concat_ws(" ", "query", "passage"))
    names = F.coalesce("expected_entities", F.array().cast("array<string>"))
    hits = F.size(F.filter(names, lambda n: F.contains(text, F.lower(n))))
    return items_.select("item_id", F.when(F.size(names) > 0, F.round(hits / F.size(names), 6)).otherwise(0.0).alias("fraction"))


def running_share(log: DataFrame) -> DataFrame:
    """Per day the compilations so far: one row a day enters the window."""
    rows = once(log.select("id", "created_at")).filter("created_at is not null").groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(rows_as("n"))
    w = Window.orderBy("day")
    return rows.withColumn("so_far", F.sum("n").over(w))  # one row per day, a calendar
