"""Facts, entities and episodes: identity, validity, provenance and graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import micros
from tidemark.operators.common import episodes_once, latest, live, once
from tidemark.operators.skew import TARGET, hot_cuts, slotted

AS_OF = "2025-07-01 00:00:00"
MODES = ["live_mcp_capture", "user_authored_seed", "vendor_import"]  # fixed values, most authoritative first
COEFFICIENTS = [1.0, 0.8, 0.6]  # fixed values of these modes
ENTITY_TYPES = ["person", "organization", "project", "service", "technology", "pattern", "environment", "document", "metric", "decision"]

def rows_as(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def facts_once(facts: DataFrame, *columns: str) -> DataFrame:
    """Live facts, one row per id, keys in lower case."""
    rows = once(live(facts).select(*dict.fromkeys(["id", *columns])))
    for c in ("subject_id", "object_id", "superseded_by"):
        if c in columns:
            rows = rows.withColumn(c, F.lower(c))
    return rows


# Deleted rows, current facts, validity


def deleted(df: DataFrame, table: str) -> DataFrame:
    """Soft-deleted ids of a table with the day of their deletion."""
    return once(df.filter("deleted_at is not null").select("id", "namespace", "deleted_at")).select(F.lit(table).alias("source_table"), "id", "namespace", F.date_format("deleted_at", "yyyy-MM-dd").alias("day"))


def current_facts(facts: DataFrame) -> DataFrame:
    return facts_once(facts, "namespace", "subject_id", "predicate", "object_id", "valid_until").filter("valid_until is null").drop("valid_until")


def facts_as_of(facts: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Facts valid at a time: valid_from <= t < valid_until, which is open where null.  A null valid_from is never valid."""
    t = F.lit(as_of).cast("timestamp_ntz")
    rows = facts_once(facts, "subject_id", "predicate", "object_id", "valid_from", "valid_until")
    return rows.filter((F.col("valid_from") <= t) & (F.col("valid_until").isNull() | (F.col("valid_until") > t))).drop("valid_from", "valid_until")


def duplicate_facts(facts: DataFrame) -> DataFrame:
    """``id, rank``: facts that repeat an earlier one with the same namespace, subject, predicate, object and source list."""
    rows = facts_once(facts, "namespace", "subject_id", "predicate", "object_id", "source_episodes", "created_at")
    w = Window.partitionBy("namespace", "subject_id", "predicate", "object_id", "source_episodes").orderBy(F.asc_nulls_last("created_at"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter("rank > 1").select("id", "rank")


def supersede(facts: DataFrame, target: int = TARGET) -> DataFrame:
    """``id, replaced_by, closes_us``: which fact closes which.

    Facts of a namespace, subject and predicate that begin at one time form a step, whose first fact (least id) wins.  A fact is closed by its
    own step's winner where their objects differ, else by the next winner with another object.  Facts with null keys or times take no part.
    A key with more than ``target`` facts is cut into slots of time of about as many; what goes on across slots passes through one summary row per slot.
    """
    key = ["namespace", "subject_id", "predicate"]
    timed = lambda df: df.withColumn("us", micros("valid_from")).drop("valid_from").dropna()
    scanned = timed(live(facts).select("namespace", F.lower("subject_id").alias("subject_id"), "predicate", "valid_from"))
    hot = hot_cuts(scanned, key, "us", facts.count(), target)
    rows = slotted(timed(facts_once(facts, *key, "object_id", "valid_from")), key, "us", hot).select("id", *key, "object_id", "us", "slot")
    step = Window.partitionBy(*key, "slot", "us").orderBy("id")
    rows = rows.withColumn("n", F.row_number().over(step)).withColumn("win", F.first(F.struct("object_id", "id", "us")).over(step))
    own = Window.partitionBy(*key, "slot").orderBy("us", "id")
    back = Window.partitionBy(*key, "slot").orderBy(F.desc("us"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)  # growing frames are linear
    winner = F.when(F.col("n") == 1, F.col("object_id"))
    prev = F.last(winner, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("prev", prev)
    if hot is not None:
        ends = rows.filter("slot > 0 and n = 1").groupBy(*key, "slot").agg(F.max_by("object_id", F.struct("us", "id")).alias("end"))
        w = Window.partitionBy(*key).orderBy("slot")
        ends = ends.select(*key, "slot", F.lag("end").over(w).alias("carried"))
        rows = rows.join(F.broadcast(ends), [*key, "slot"], "left").withColumn("prev", F.coalesce("prev", "carried")).drop("carried")  # at most MOST slots
    change = F.when((F.col("n") == 1) & (F.col("prev").isNull() | (F.col("prev") != F.col("object_id"))), F.struct("us", "id"))
    rows = rows.withColumn("change", change).withColumn("next", F.last("change", ignorenulls=True).over(back))
    if hot is not None:
        heads = rows.filter("slot > 0").groupBy(*key, "slot").agg(F.min("change").alias("head"))
        w = Window.partitionBy(*key).orderBy("slot").rowsBetween(1, Window.unboundedFollowing)
        heads = heads.select(*key, "slot", F.first("head", ignorenulls=True).over(w).alias("ahead"))
        rows = rows.join(F.broadcast(heads), [*key, "slot"], "left").withColumn("next", F.coalesce("next", "ahead"))  # at most MOST slots
    by = F.when(F.col("win.object_id") != F.col("object_id"), F.struct(F.col("win.us").alias("us"), F.col("win.id").alias("id"))).otherwise(F.col("next"))
    return rows.select("id", by.alias("by")).filter("by is not null").select("id", F.col("by.id").alias("replaced_by"), F.col("by.us").alias("closes_us"))


# Joins of facts, entities and episodes


def fact_names(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Current facts with the names of both ends (inner joins; adaptive execution splits hot subjects)."""
    n = once(live(entities).select("id", "name")).select(F.lower("id").alias("e"), "name")
    f = current_facts(facts)
    s, o = n.toDF("subject_id", "subject"), n.toDF("object_id", "object")
    return f.join(s, "subject_id").join(o, "object_id").select("id", "namespace", "subject", "predicate", "object")


def entity_degree(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Per live entity: facts as subject, as object and current ones among them: two directed edge sets, pre-aggregated, not an OR-join."""
    f = facts_once(facts, "subject_id", "object_id", "valid_until")
    ends = f.select(F.col("subject_id").alias("e"), F.lit(1).alias("s"), F.col("valid_until").isNull().alias("c")).unionByName(f.select(F.col("object_id").alias("e"), F.lit(0).alias("s"), F.col("valid_until").isNull().alias("c")))
    n = ends.groupBy("e").agg(F.sum("s").alias("as_subject"), F.sum(1 - F.col("s")).alias("as_object"), F.count(F.when(F.col("c"), 1)).alias("current"))
    ids = once(live(entities).select("id", "entity_type")).select(F.lower("id").alias("e"), "entity_type")
    return ids.join(n, "e", "left").fillna(0).select(F.col("e").alias("entity_id"), "entity_type", "as_subject", "as_object", "current")


def fact_ends(facts: DataFrame, historical: bool = False) -> DataFrame:
    """``namespace, e, fact_id, subject_id, predicate, object_id, state``: each fact once per entity at its ends, found by two equi-joins, not an OR-join.

    Current facts only, or with ``historical`` closed and deleted ones too; of an id written both live and deleted the live row counts.
    """
    cols = ["id", "namespace", "subject_id", "predicate", "object_id", "valid_until", "deleted_at"]
    f = once(facts.select(*cols), "id", F.asc_nulls_first("deleted_at")) if historical else once(live(facts).select(*cols)).filter("valid_until is null")
    state = F.when(F.col("deleted_at").isNotNull(), "deleted").when(F.col("valid_until").isNotNull(), "closed").otherwise("current")
    rows = f.select("namespace", F.lower("id").alias("fact_id"), F.lower("subject_id").alias("subject_id"), "predicate", F.lower("object_id").alias("object_id"), state.alias("state"))
    return rows.withColumn("e", F.explode(F.array_distinct(F.array("subject_id", "object_id")))).filter("e is not null")


def entity_facts(facts: DataFrame, entities: DataFrame, historical: bool = False) -> DataFrame:
    """The facts of its namespace about every live entity, a fact once per entity."""
    ids = once(live(entities).select("id", "namespace")).select(F.lower("id").alias("e"), "namespace")
    return ids.join(fact_ends(facts, historical), ["namespace", "e"]).select(F.col("e").alias("entity_id"), "namespace", "fact_id", "subject_id", "predicate", "object_id", "state")


def recall(facts: DataFrame, entities: DataFrame, historical: bool = False) -> DataFrame:
    """The facts about every name of a namespace: names compare without case and mean their least live id, as the reference takes one row."""
    ids = once(live(entities).select("id", "name", "namespace")).groupBy("namespace", F.lower("name").alias("name")).agg(F.min(F.lower("id")).alias("e")).dropna()
    return ids.join(fact_ends(facts, historical), ["namespace", "e"]).select("namespace", "name", F.col("e").alias("entity_id"), "fact_id", "subject_id", "predicate", "object_id", "state")


def best_mode(facts: DataFrame, episodes: DataFrame) -> DataFrame:
    """Per fact the most authoritative ingestion mode among its live source episodes, null where none is known."""
    refs = facts_once(facts, "source_episodes").select("id", F.explode_outer(F.array_distinct(F.transform("source_episodes", F.lower))).alias("e"))
    modes = episodes_once(episodes, "ingestion_mode").select(F.lower("id").alias("e"), (F.array_position(F.array(*map(F.lit, MODES)), F.col("ingestion_mode"))).alias("m")).filter("m > 0")
    out = refs.join(modes, "e", "left").groupBy("id").agg(F.min("m").alias("m"))
    return out.select("id", F.get(F.array(*map(F.lit, MODES)), (F.col("m") - 1).cast("int")).alias("mode"))


def superseding_facts(facts: DataFrame) -> DataFrame:
    """Facts that some live fact names as its successor (semi-join)."""
    f = facts_once(facts, "superseded_by")
    return f.select(F.lower("id").alias("id")).join(f.select(F.col("superseded_by").alias("id")).dropna().distinct(), "id", "left_semi")


def uncited_episodes(episodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Episodes that no live fact cites (anti-join)."""
    cited = live(facts).select(F.explode("source_episodes").alias("e")).select(F.lower("e").alias("id")).dropna().distinct()
    return episodes_once(episodes, "namespace").select(F.lower("id").alias("id"), "namespace").join(cited, "id", "left_anti")


def already_stored(deliveries: DataFrame, episodes: DataFrame) -> DataFrame:
    """Deliveries whose content hash or event id an episode of the namespace has: two semi-joins, one for each key."""
    bare = lambda c: F.regexp_replace(F.lower(c), "^sha256:", "")
    d = deliveries.select("delivery_id", "namespace", "source", "source_event_id", F.coalesce(bare("content_hash"), F.sha2(F.col("content").cast("binary"), 256)).alias("h"))
    e = episodes.select("namespace", "source", "source_event_id", bare("content_hash").alias("h"))
    by_hash = d.join(e.select("namespace", "h").distinct(), ["namespace", "h"], "left_semi").select("delivery_id", F.lit("content_hash").alias("matched"))
    by_event = d.join(e.select("namespace", "source", "source_event_id").distinct(), ["namespace", "source", "source_event_id"], "left_semi").select("delivery_id", F.lit("source_event_id").alias("matched"))
    return by_hash.unionByName(by_event)


def upsert_episodes(deliveries: DataFrame, episodes: DataFrame) -> DataFrame:
    """What an idempotent load does with each batch: inserted and existing deliveries by (namespace, source, event id)."""
    first = latest(deliveries.filter("source_event_id is not null").select("delivery_id", "batch_id", "delivered_at", "namespace", "source", "source_event_id"), ["namespace", "source", "source_event_id"], [F.asc_nulls_last("delivered_at"), F.asc("delivery_id")], 1)
    new = first.join(episodes.select("namespace", "source", "source_event_id").distinct(), ["namespace", "source", "source_event_id"], "left_anti").select("delivery_id", F.lit(1).alias("new"))
    return deliveries.select("delivery_id", "batch_id", "source_event_id").join(new, "delivery_id", "left").groupBy("batch_id").agg(
        F.count("new").alias("inserted"), F.count(F.when(F.col("source_event_id").isNotNull() & F.col("new").isNull(), 1)).alias("existing"), F.count(F.when(F.col("source_event_id").isNull(), 1)).alias("without_id"))


# Identity


def hash_check(episodes: DataFrame) -> DataFrame:
    """Episodes whose stored hash is not the SHA-256 of their content."""
    rows = episodes_once(episodes, "content", "content_hash")
    return rows.withColumn("sha", F.sha2(F.col("content").cast("binary"), 256)).filter(~F.col("sha").eqNullSafe(F.regexp_replace(F.lower("content_hash"), "^sha256:", ""))).select("id", "sha")


def repeats(episodes: DataFrame, keys: list[str]) -> DataFrame:
    """``id, first_id`` of episodes that repeat an earlier one by ``keys``, also a deleted one; null keys repeat nothing."""
    rows = once(episodes.select("id", "ingested_at", *keys), "id", F.asc_nulls_last("ingested_at")).dropna(subset=keys)
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("ingested_at"), "id")
    return rows.withColumn("first_id", F.first("id").over(w)).filter("id <> first_id").select("id", "first_id")


def invalid_episodes(episodes: DataFrame) -> DataFrame:
    """``id, rule`` of rows that break a rule: blank fields, unknown modes, parser fields that do not go with the mode."""
    vendor = F.col("ingestion_mode") == "vendor_import"
    parser = F.col("parser_version").isNotNull() & F.col("parser_source_schema").isNotNull()
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    rules = F.array(*[F.when(c, F.lit(n)) for n, c in (
        ("blank_content", blank("content")), ("blank_source", blank("source")), ("blank_namespace", blank("namespace")),
        ("unknown_mode", ~F.coalesce(F.col("ingestion_mode").isin(MODES), F.lit(False))), ("vendor_without_parser", vendor & ~parser),
        ("parser_without_vendor", ~vendor & (F.col("parser_version").isNotNull() | F.col("parser_source_schema").isNotNull())),
        ("ingested_before_it_happened", F.col("ingested_at") < F.col("occurred_at")))])
    return episodes_once(episodes, "content", "source", "namespace", "ingestion_mode", "parser_version", "parser_source_schema", "occurred_at").select("id", F.explode(F.array_compact(rules)).alias("rule"))


def valid_types(entities: DataFrame) -> DataFrame:
    """Live entities whose type, without case, is one of the ten; others and those without type are dropped."""
    return once(live(entities).select("id", "name", "entity_type", "namespace")).filter(F.lower("entity_type").isin(ENTITY_TYPES)).select(F.lower("id").alias("entity_id"), "name", "entity_type", "namespace")


def aliases(entities: DataFrame) -> DataFrame:
    """``entity_id, name, entity_type, namespace, alias``; broken or missing properties have no aliases."""
    rows = once(live(entities).select("id", "name", "entity_type", "namespace", "properties"))
    found = F.from_json("properties", "aliases array<string>")["aliases"]
    return rows.select(F.lower("id").alias("entity_id"), "name", "entity_type", "namespace", F.explode(F.array_distinct(found)).alias("alias")).filter("alias is not null")


def alias_set_merge(entities: DataFrame) -> DataFrame:
    """Per (name without case, type, namespace) the union of names and aliases, sorted."""
    rows = once(live(entities).select("id", "name", "entity_type", "namespace", "properties"))
    own = F.array_union(F.array("name"), F.coalesce(F.from_json("properties", "aliases array<string>")["aliases"], F.array().cast("array<string>")))
    return rows.select(F.lower("name").alias("key"), "entity_type", "namespace", F.explode(own).alias("a")).groupBy("key", "entity_type", "namespace").agg(F.array_join(F.sort_array(F.collect_set("a")), "|").alias("aliases"))


def resolve(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """``mention_id, method, confidence, entity_id`` of mentions (mention_id, name, entity_type, namespace).

    exact: the name without case is an entity's, confidence 1; alias: exactly one entity of the type and namespace has the name, in its
    letter case, among its aliases, 0.95; otherwise new.  Ties of exact matches go to the least id.
    """
    own = once(live(entities).select("id", "name", "entity_type", "namespace"))
    scope = ["entity_type", "namespace"]
    names = own.groupBy(F.lower("name").alias("k"), *scope).agg(F.min(F.lower("id")).alias("exact_id"))
    forms = aliases(entities).groupBy(F.col("alias").alias("name"), *scope).agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("alias_id"))
    rows = mentions.withColumn("k", F.lower("name")).join(names, ["k", *scope], "left").join(forms.filter("n = 1").drop("n"), ["name", *scope], "left")
    method = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("alias_id").isNotNull(), "alias").otherwise("new")
    return rows.select("mention_id", method.alias("method"), F.when(method == "exact", 1.0).when(method == "alias", 0.95).otherwise(0.0).alias("confidence"), F.coalesce("exact_id", "alias_id").alias("entity_id"))


def resolve_aliases(entities: DataFrame) -> DataFrame:
    """Every alias as a mention of its type and namespace."""
    m = aliases(entities).select(F.concat_ws("#", "entity_id", "alias").alias("mention_id"), F.col("alias").alias("name"), "entity_type", "namespace")
    return resolve(m, entities)


def provenance(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Per entity the number of distinct episodes that it or a fact about it cites, each counted once."""
    own = live(entities).select(F.lower("id").alias("entity_id"), F.explode("source_episodes").alias("e"))
    f = facts_once(facts, "subject_id", "object_id", "source_episodes")
    about = f.select(F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("entity_id"), "source_episodes").select("entity_id", F.explode("source_episodes").alias("e"))
    known = live(entities).select(F.lower("id").alias("entity_id")).distinct()
    pairs = own.unionByName(about).select("entity_id", F.lower("e").alias("e")).dropna().distinct()
    return pairs.groupBy("entity_id").agg(rows_as("episodes")).join(known, "entity_id", "left_semi")


def namespace_mismatch(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Ends of facts whose entity lives in another namespace."""
    n = once(live(entities).select("id", "namespace")).select(F.lower("id").alias("e"), F.col("namespace").alias("other"))
    f = facts_once(facts, "namespace", "subject_id", "object_id")
    ends = f.select("id", "namespace", F.explode(F.array(F.struct(F.lit("subject_id").alias("field"), F.col("subject_id").alias("e")), F.struct(F.lit("object_id").alias("field"), F.col("object_id").alias("e")))).alias("x")).select("id", "namespace", "x.field", "x.e")
    return ends.join(n, "e").filter("namespace <> other").select("id", "field", "namespace", "other")


def missing_inverses(facts: DataFrame, predicates: DataFrame) -> DataFrame:
    """Per predicate with an inverse: current facts, and those whose inverse fact is current too."""
    inv = predicates.select("predicate", "inverse").dropna()
    f = current_facts(facts).select("namespace", "subject_id", "predicate", "object_id").distinct()
    back = f.select("namespace", F.col("subject_id").alias("object_id"), F.col("predicate").alias("inverse"), F.col("object_id").alias("subject_id"), F.lit(1).alias("hit"))
    out = f.join(inv, "predicate").join(back, ["namespace", "subject_id", "object_id", "inverse"], "left")
    return out.groupBy("predicate", "inverse").agg(rows_as("facts"), F.count("hit").alias("with_inverse"))


# Chains and patterns


def chain_roots(facts: DataFrame) -> DataFrame:
    """``id, root, hops``: where following superseded_by from each replaced fact ends; root is null where the way runs in a circle.

    Pointer doubling: each round joins only the pointers that still move with all pointers known so far, so the number of rounds is the
    logarithm of the longest way, however long.  A way of more hops than there are pointers runs in a circle.  Each round is checkpointed.  A
    pointer to a fact that does not exist or is deleted ends the way before it.
    """
    from tidemark.session import shared_dir

    shared_dir(facts.sparkSession)
    f = facts_once(facts, "superseded_by").select(F.lower("id").alias("id"), F.col("superseded_by").alias("to"))
    ids = f.select(F.col("id").alias("to"))
    moving = f.filter("to is not null").join(ids, "to", "left_semi").select("id", "to", F.lit(1).cast("bigint").alias("hops")).checkpoint()
    most = moving.count()
    done = moving.limit(0)
    left = most
    while left:
        nxt = moving.unionByName(done).select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("hops").alias("hops2"))
        step = moving.join(nxt, "to", "left").select("id", F.coalesce("to2", "to").alias("to"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"), F.col("to2").isNotNull().alias("moved")).checkpoint()
        goes_on = F.col("moved") & (F.col("hops") <= F.lit(most))
        done = done.unionByName(step.filter(~goes_on).drop("moved"))
        moving = step.filter(goes_on).drop("moved")
        left = moving.count()
    ends = done.join(f.filter("to is null or to = id").select(F.col("id").alias("to"), F.lit(True).alias("end")), "to", "left")
    dangling = f.join(ids, "to", "left_anti").select(F.col("id").alias("to"), F.lit(True).alias("dangling"))
    out = ends.join(dangling, "to", "left").withColumn("ok", F.coalesce("end", "dangling", F.lit(False)) & (F.col("hops") <= F.lit(most)))
    return out.select("id", F.when(F.col("ok"), F.col("to")).alias("root"), F.when(F.col("ok"), F.col("hops")).alias("hops"))


def repeated_predicates(facts: DataFrame, least: int = 2) -> DataFrame:
    """Per episode, predicates used at least twice, with the numbers of subjects and objects."""
    rows = facts_once(facts, "subject_id", "predicate", "object_id", "source_episodes").withColumn("episode_id", F.explode(F.array_distinct(F.transform("source_episodes", F.lower)))).filter("episode_id is not null")
    return rows.groupBy("episode_id", "predicate").agg(rows_as("uses"), F.count_distinct("subject_id").alias("subjects"), F.count_distinct("object_id").alias("objects")).filter(F.col("uses") >= least)


def workflow_chains(facts: DataFrame) -> DataFrame:
    """Per predicate and namespace, a -> b -> c: facts whose object is the subject of a fact with the same predicate.

    Both sides are first counted per (namespace, predicate, entity), so a hub joins as one row, and the products are summed.
    """
    f = facts_once(facts, "namespace", "subject_id", "predicate", "object_id")
    left = f.groupBy("namespace", "predicate", F.col("object_id").alias("b")).agg(rows_as("n_in"))
    right = f.groupBy("namespace", "predicate", F.col("subject_id").alias("b")).agg(rows_as("n_out"))
    return left.join(right, ["namespace", "predicate", "b"]).groupBy("namespace", "predicate").agg(F.sum(F.col("n_in") * F.col("n_out")).alias("chains"), rows_as("middles"))


def procedure_confidence(facts: DataFrame) -> DataFrame:
    """Per predicate and namespace: distinct episodes n, confidence 1 - 0.7 * 0.85**(n - 1) and whether it reaches 0.8 with 3 observations."""
    rows = facts_once(facts, "namespace", "predicate", "source_episodes").select("namespace", "predicate", F.explode("source_episodes").alias("e")).select("namespace", "predicate", F.lower("e").alias("e")).dropna(subset=["e"]).distinct()
    c = 1 - 0.7 * F.pow(F.lit(0.85), F.col("observations") - 1)
    return rows.groupBy("namespace", "predicate").agg(rows_as("observations")).withColumn("confidence", F.round(c, 6)).withColumn("promoted", (c >= 0.8) & (F.col("observations") >= 3))
