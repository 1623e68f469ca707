"""Lookups, filters with optional arguments, loads that keep what is there, and checks of what a model cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import micros
from tidemark.operators.common import episodes_once, latest, live, once
from tidemark.operators.deliveries import firsts, messages
from tidemark.operators.memory import AS_OF, COEFFICIENTS, MODES, aliases, already_stored, facts_once, hash_check, repeats, rows_as
from tidemark.operators.metrics import candidate_occurrences
from tidemark.operators.retrieval import recency


def every_given(**conditions: Column | None) -> Column:
    """All conditions that are given; none at all is true."""
    out = F.lit(True)
    for c in conditions.values():
        out = out if c is None else out & c
    return out


def filtered_entities(entities: DataFrame, namespace: str | None = None, entity_type: str | None = None, part: str | None = None) -> DataFrame:
    """Live entities by optional namespace, type and part of the name (without case); only given arguments reach the scan."""
    like = None if part is None else F.contains(F.lower("name"), F.lit(part.lower()))
    rows = live(entities).filter(every_given(ns=None if namespace is None else F.col("namespace") == namespace, kind=None if entity_type is None else F.col("entity_type") == entity_type, part=like))
    return once(rows.select("id", "name", "entity_type", "namespace"))


def filtered_facts(facts: DataFrame, namespace: str | None = None, predicate: str | None = None, status: str | None = None) -> DataFrame:
    """Live facts by optional namespace, predicate and evidence status."""
    given = every_given(**{c: None if v is None else F.col(c) == v for c, v in (("namespace", namespace), ("predicate", predicate), ("evidence_status", status))})
    return facts_once(facts.filter(given), "namespace", "subject_id", "predicate", "object_id")


def by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the asked ids (one column ``id``), without letter case, each once: a semi-join, which Spark broadcasts where the ids are few."""
    asked = ids.select(F.lower("id").alias("__i")).dropna().distinct()
    return once(df).join(asked, F.lower(df["id"]) == F.col("__i"), "left_semi")


def fact_points(facts: DataFrame) -> DataFrame:
    """Facts that replace another one, looked up by id, whether live or not."""
    rows = facts.select("id", "namespace", "predicate")
    return by_ids(rows, live(facts).select(F.col("superseded_by").alias("id")))


def not_done(episodes: DataFrame) -> DataFrame:
    """Episodes whose flag is false or null: the third state counts as no."""
    return episodes_once(episodes, "namespace", "processed").filter(~F.coalesce("processed", F.lit(False))).select("id", "namespace")


def predicates_of_packs(predicates: DataFrame, packs: list[str]) -> DataFrame:
    return predicates.filter(F.col("pack").isin(packs)).select("predicate", "pack", "category")


def review_candidates(facts: DataFrame, predicates: DataFrame, least: int = 5) -> DataFrame:
    """Unregistered predicates that occur often enough to be reviewed."""
    return candidate_occurrences(facts, predicates).filter(F.col("occurrences") >= least)


def recent_errors(episodes: DataFrame, n: int = 10) -> DataFrame:
    """Per namespace the ``n`` episodes that failed last, each once at its latest attempt."""
    rows = live(episodes).filter("processing_last_error is not null and id is not null")
    one = rows.groupBy(F.lower("id").alias("id")).agg(F.max(F.struct("processing_last_attempt", "namespace", "processing_last_error")).alias("x")).select("id", "x.*")
    top = latest(one, ["namespace"], [F.desc_nulls_last("processing_last_attempt"), F.asc("id")], n)
    return top.select("namespace", "rank", "id", F.col("processing_last_error").alias("error"))


def strip_fences(c: Column) -> Column:
    """A model's reply without the code fence around it."""
    c = F.regexp_replace(c, r"^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(c, r"^```(json)?", ""), r"```$", "")
    return F.when(c.startswith("```"), F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(c)


def unfenced(documents: DataFrame) -> DataFrame:
    """Every text put between fences as models reply, and without them again: ``doc_id, chars, digest``."""
    reply = F.concat(F.when(F.col("doc_id") % 2 == 0, "```json\n").otherwise("```\n"), "text", F.lit("\n```"))
    rows = documents.filter("text is not null and doc_id is not null").select("doc_id", strip_fences(reply).alias("t"))
    return rows.select("doc_id", F.length("t").cast("bigint").alias("chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


def cited_outside(facts: DataFrame, least: int = 2) -> DataFrame:
    """Per cluster (namespace, subject) of at least ``least`` live facts: the facts it cites as successors, and how many of these are no members.

    Citations join members; no list of a cluster is built.  A cluster is accepted where it cites no stranger.
    """
    f = facts_once(facts, "namespace", "subject_id", "superseded_by").filter("subject_id is not null")
    size = f.groupBy("namespace", "subject_id").agg(rows_as("members")).filter(F.col("members") >= least)
    cites = f.filter("superseded_by is not null").select("namespace", "subject_id", F.col("superseded_by").alias("c")).distinct()
    inside = f.select("namespace", "subject_id", F.lower("id").alias("c"), F.lit(1).alias("hit"))
    n = cites.join(inside, ["namespace", "subject_id", "c"], "left").groupBy("namespace", "subject_id").agg(rows_as("cited"), F.count(F.when(F.col("hit").isNull(), 1)).alias("strangers"))
    return size.join(n, ["namespace", "subject_id"]).withColumn("accepted", F.col("strangers") == 0)


def cluster_lines(facts: DataFrame, entities: DataFrame, least: int = 10) -> DataFrame:
    """The lines of every large cluster of facts that nothing replaced, one row each: ``- [id] subject predicate object (evidence: status)``."""
    f = facts_once(facts, "namespace", "subject_id", "predicate", "object_id", "evidence_status", "superseded_by").filter("superseded_by is null and subject_id is not null")
    big = f.groupBy("namespace", "subject_id").agg(rows_as("c")).filter(F.col("c") >= least).select("namespace", "subject_id")
    n = once(live(entities).select("id", "name")).select(F.lower("id").alias("e"), F.coalesce("name", F.lit("")).alias("name"))
    rows = f.join(big, ["namespace", "subject_id"], "left_semi").join(n.toDF("subject_id", "s"), "subject_id").join(n.toDF("object_id", "o"), "object_id")
    line = F.concat(F.lit("- ["), F.lower("id"), F.lit("] "), "s", F.lit(" "), F.coalesce("predicate", F.lit("")), F.lit(" "), "o", F.lit(" (evidence: "), F.coalesce("evidence_status", F.lit("none")), F.lit(")"))
    return rows.select("namespace", "subject_id", line.alias("line"))


def task_classes(items: DataFrame) -> DataFrame:
    """The class that a task's name begins with, else chat."""
    names = {"debug_": "debug", "arch_": "architecture", "compliance_": "compliance", "writing_": "writing"}  # fixed values
    kind = F.coalesce(*[F.when(F.col("task_name").startswith(k), v) for k, v in names.items()], F.lit("chat"))
    return items.select("item_id", "task_name", kind.alias("task_class"))


# Loads


def insert_if_absent(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key (compared without case, nulls equal) is not stored, one per key: the one with the least ``id``."""
    k = [F.lower(c).alias(f"__{c}") for c in keys]
    first = new.select("*", *k).withColumn("__rn", F.row_number().over(Window.partitionBy(*[f"__{c}" for c in keys]).orderBy("id"))).filter("__rn = 1")
    old = stored.select(*[F.lower(c).alias(f"s_{c}") for c in keys]).distinct()
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"__{c}").eqNullSafe(F.col(f"s_{c}"))
    return first.join(old, same, "left_anti").select(*new.columns)


def new_entities(entities: DataFrame) -> DataFrame:
    """Aliases as entities to be loaded: those whose name no live entity of the type and namespace has."""
    rows = aliases(entities).select(F.concat_ws("#", "entity_id", "alias").alias("id"), F.col("alias").alias("name"), "entity_type", "namespace")
    return insert_if_absent(rows, live(entities), ["name", "entity_type", "namespace"])


def upserted(old: DataFrame, new: DataFrame, key: str, kept: list[str], replaced: list[str]) -> DataFrame:
    """The next version of a state table: new rows come in, of known ones ``replaced`` columns take the new value and ``kept`` ones only where it is not null."""
    o = old.select(key, *[F.col(c).alias(f"o_{c}") for c in [*kept, *replaced]])
    n = new.select(key, *kept, *replaced, F.lit(True).alias("__new"))
    cols = [F.coalesce(c, f"o_{c}").alias(c) for c in kept] + [F.when(F.col("__new"), F.col(c)).otherwise(F.col(f"o_{c}")).alias(c) for c in replaced]
    return o.join(n, key, "full").select(key, *cols)


def fact_state(facts: DataFrame, cut: str = "2025-06-15 00:00:00") -> DataFrame:
    """State per subject (highest confidence, facts, time of the last one) of the facts up to ``cut``, brought up to date with those after it."""
    f = facts_once(facts, "subject_id", "properties", "created_at").filter("subject_id is not null and created_at is not null")
    f = f.withColumn("c", F.get_json_object("properties", "$.confidence").cast("double"))
    state = lambda rows: rows.groupBy("subject_id").agg(F.max("c").alias("confidence"), rows_as("facts"), F.max(micros("created_at")).alias("last_us"))
    t = F.lit(cut).cast("timestamp_ntz")
    return upserted(state(f.filter(F.col("created_at") < t)), state(f.filter(F.col("created_at") >= t)), "subject_id", ["confidence"], ["facts", "last_us"])


def learn_status(deliveries: DataFrame, episodes: DataFrame) -> DataFrame:
    """``delivery_id, status``: duplicate where the delivery repeats an earlier one or an episode has its hash or event id, else queued."""
    rows = messages(deliveries).filter("delivery_id is not null")
    first = firsts(rows).select("delivery_id", F.lit(1).alias("first")).distinct()
    stored = already_stored(deliveries, episodes).select("delivery_id", F.lit(1).alias("stored")).distinct()
    out = rows.select("delivery_id").distinct().join(first, "delivery_id", "left").join(stored, "delivery_id", "left")
    return out.select("delivery_id", F.when(F.col("first").isNull() | F.col("stored").isNotNull(), "duplicate").otherwise("queued").alias("status"))


# Identity by aliases, both ways


def resolve_by_alias(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """``mention_id, entity_id, confidence, append``: mentions (mention_id, name, entity_type, namespace, aliases) that exactly one entity of their type
    and namespace matches: it has the name, in its letter case, among its aliases, or one of the mention's aliases, without case, is its name.

    ``append`` says that the name is to be added to the entity's aliases, where it is not among them without case.  Several matches
    are none; null names and aliases match nothing.
    """
    scope = ["entity_type", "namespace"]
    own = aliases(entities)
    forward = mentions.select("mention_id", "name", *scope).join(own.select(F.col("alias").alias("name"), *scope, "entity_id"), ["name", *scope]).select("mention_id", "entity_id")
    named = once(live(entities).select("id", "name", *scope)).groupBy(F.lower("name").alias("k"), *scope).agg(F.min(F.lower("id")).alias("entity_id"))
    back = mentions.select("mention_id", *scope, F.explode("aliases").alias("a")).select("mention_id", *scope, F.lower("a").alias("k")).join(named, ["k", *scope]).select("mention_id", "entity_id")
    hits = forward.unionByName(back).distinct().groupBy("mention_id").agg(rows_as("c"), F.min("entity_id").alias("entity_id")).filter("c = 1").drop("c")
    known = own.select("entity_id", F.lower("alias").alias("low"), F.lit(True).alias("known")).distinct()
    out = hits.join(mentions.select("mention_id", F.lower("name").alias("low")), "mention_id").join(known, ["entity_id", "low"], "left")
    return out.select("mention_id", "entity_id", F.lit(0.95).alias("confidence"), F.col("known").isNull().alias("append"))


def mentions_again(entities: DataFrame) -> DataFrame:
    """Every live entity as another text would mention it: its name in capitals, its name and aliases as aliases."""
    rows = once(live(entities).filter("id is not null").select("id", "name", "entity_type", "namespace", "properties"))
    own = F.coalesce(F.from_json("properties", "aliases array<string>")["aliases"], F.array().cast("array<string>"))
    return rows.select(F.lower("id").alias("mention_id"), F.upper("name").alias("name"), "entity_type", "namespace", F.concat(own, F.array("name")).alias("aliases"))


def resolve_mentions(entities: DataFrame) -> DataFrame:
    return resolve_by_alias(mentions_again(entities), entities)


# Estimates and scores of episodes, and series


def episode_scores(episodes: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """``id, tokens, recency, provenance``: a quarter of the content's bytes, 20 to 200; decay with a half-life of 30 days of whole hours; 0.8 times the
    coefficient of the ingestion mode (1 where it is unknown).  A null time has recency 0, a null content 20 tokens."""
    rows = episodes_once(episodes, "content", "occurred_at", "ingestion_mode")
    tokens = F.greatest(F.lit(20), F.least(F.lit(200), F.coalesce(F.floor(F.octet_length("content") / 4), F.lit(0)))).cast("int")
    by_mode = F.coalesce(*[F.when(F.col("ingestion_mode") == m, F.lit(c)) for m, c in zip(MODES, COEFFICIENTS)], F.lit(1.0))
    return rows.select("id", tokens.alias("tokens"), F.round(F.coalesce(recency(F.col("occurred_at"), as_of), F.lit(0.0)), 5).alias("recency"), F.round(0.8 * by_mode, 5).alias("provenance"))


def audit_page(log: DataFrame, page: int = 2, size: int = 5) -> DataFrame:
    """One page of each namespace's compilations, newest first: ranks beyond the page are dropped before the shuffle."""
    rows = latest(once(log.select("id", "namespace", "created_at", "task_class")), ["namespace"], [F.desc("created_at"), F.desc("id")], page * size)
    return rows.filter(F.col("rank") > (page - 1) * size).select("namespace", "rank", "id", "task_class")


def compilations_per_minute(log: DataFrame) -> DataFrame:
    rows = once(log.select("id", "created_at")).filter("created_at is not null")
    return rows.groupBy(F.date_format(F.date_trunc("minute", "created_at"), "yyyy-MM-dd HH:mm").alias("minute")).agg(rows_as("compilations"))


def today_precision(log: DataFrame) -> DataFrame:
    """Per namespace the mean share of selected candidates on its latest day, and over all days."""
    rows = once(log.select("id", "namespace", "created_at", "candidates_found", "candidates_selected")).filter("created_at is not null")
    p = F.when(F.col("candidates_found") > 0, F.col("candidates_selected") / F.col("candidates_found")).otherwise(F.lit(0.0))
    days = rows.groupBy("namespace", F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.sum(p).alias("s"), rows_as("c"))
    return days.groupBy("namespace").agg(F.max("day").alias("day"), F.round(F.max_by(F.col("s") / F.col("c"), "day"), 6).alias("today"), F.round(F.sum("s") / F.sum("c"), 6).alias("mean"))


# The same checks on deliveries, where messages do repeat


def as_episodes(deliveries: DataFrame) -> DataFrame:
    """Deliveries under the column names of episodes; none is deleted."""
    return deliveries.withColumn("id", F.col("delivery_id").cast("string")).withColumn("ingested_at", F.col("delivered_at")).withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))


def delivery_hashes(deliveries: DataFrame) -> DataFrame:
    return hash_check(as_episodes(deliveries))


def delivery_repeats(deliveries: DataFrame, keys: list[str]) -> DataFrame:
    return repeats(as_episodes(deliveries), keys)


def stored_before(deliveries: DataFrame, since: str = "2025-06-15 00:00:00") -> DataFrame:
    """Deliveries from ``since`` on whose hash or event id an earlier one of the namespace has."""
    t = F.lit(since).cast("timestamp_ntz")
    return already_stored(deliveries.filter(F.col("delivered_at") >= t), deliveries.filter(F.col("delivered_at") < t))
