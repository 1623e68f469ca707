"""Aggregates over episodes, entities, facts and compilations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.common import episodes_once, latest, live, once, share

def rows_as(name: str):
    return F.count(F.lit(1)).alias(name)

STAGES = ["latency_total_ms", "latency_classify_ms", "latency_retrieve_ms", "latency_rank_ms", "latency_compile_ms"]


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


def count_if(cond, name: str):
    return F.count(F.when(cond, 1)).alias(name)


def episodes_by(episodes: DataFrame, key: str) -> DataFrame:
    return episodes_once(episodes, key).groupBy(key).agg(rows_as("episodes"))


def entities_by_type(entities: DataFrame) -> DataFrame:
    return once(live(entities).select("id", "entity_type")).groupBy("entity_type").agg(rows_as("entities"))


def pipeline_health(episodes: DataFrame, entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Per namespace: episodes, processed, queue depth, entities, current and superseded facts, each table in one pass."""
    e = episodes_once(episodes, "namespace", "processed").groupBy("namespace").agg(rows_as("episodes"), count_if(F.col("processed"), "processed"))
    n = once(live(entities).select("id", "namespace")).groupBy("namespace").agg(rows_as("entities"))
    f = once(live(facts).select("id", "namespace", "valid_until", "superseded_by")).groupBy("namespace").agg(count_if(F.col("valid_until").isNull(), "current"), count_if(F.col("superseded_by").isNotNull(), "superseded"))
    out = e.join(n, "namespace", "full").join(f, "namespace", "full").fillna(0)
    return out.select("namespace", "episodes", "processed", (F.col("episodes") - F.col("processed")).alias("queue_depth"), "entities", "current", "superseded")


def current_vs_superseded(facts: DataFrame) -> DataFrame:
    """The three notions of superseded side by side, per namespace."""
    return once(live(facts).select("id", "namespace", "valid_until", "superseded_by", "evidence_status")).groupBy("namespace").agg(
        count_if(F.col("valid_until").isNull(), "current"), count_if(F.col("valid_until").isNotNull(), "ended"),
        count_if(F.col("superseded_by").isNotNull(), "replaced"), count_if(F.col("evidence_status") == "superseded", "marked"))


def latest_model(episodes: DataFrame) -> DataFrame:
    """Per namespace the newest extraction and classification model; ties by name."""
    of = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("ingested_at", c)))[c].alias(c)
    return live(episodes).groupBy("namespace").agg(of("extraction_model"), of("classification_model"))


def daily_precision(log: DataFrame) -> DataFrame:
    rows = once(log.select("id", "created_at", "candidates_found", "candidates_selected"))
    return rows.groupBy(day("created_at").alias("day")).agg(rows_as("compilations"), F.round(F.avg(share(F.col("candidates_selected").cast("double"), F.col("candidates_found"))), 6).alias("precision"))


def exact_percentiles(log: DataFrame) -> DataFrame:
    """Interpolated percentiles of measured latency per namespace: exact, from value counts."""
    rows = once(log.filter("latency_total_ms >= 0").select("id", "namespace", "latency_total_ms"))
    q = F.percentile("latency_total_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return rows.groupBy("namespace").agg(rows_as("n"), q.alias("q")).select("namespace", "n", *[F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("p50", "p95", "p99"))])


def extraction_by_model(episodes: DataFrame) -> DataFrame:
    rows = episodes_once(episodes, "extraction_model", "extraction_metrics").filter("extraction_metrics is not null")
    get = lambda f: F.get_json_object("extraction_metrics", f"$.{f}").cast("bigint")
    return rows.groupBy(F.coalesce("extraction_model", F.lit("unknown")).alias("model")).agg(
        rows_as("episodes"), F.sum(get("extracted")).alias("extracted"), F.sum(get("facts_extracted")).alias("facts"), F.round(F.avg(get("processing_time_ms")), 4).alias("avg_ms"))


def metric_totals(episodes: DataFrame) -> DataFrame:
    """Unpivot of the extraction metrics: one row per namespace and field."""
    fields = ["extracted", "facts_extracted", "processing_time_ms"]
    rows = episodes_once(episodes, "namespace", "extraction_metrics").filter("extraction_metrics is not null")
    wide = rows.select("namespace", *[F.get_json_object("extraction_metrics", f"$.{f}").cast("bigint").alias(f) for f in fields])
    return wide.unpivot("namespace", fields, "field", "v").groupBy("namespace", "field").agg(F.sum("v").alias("total"))


def custom_predicate_growth(facts: DataFrame, predicates: DataFrame) -> DataFrame:
    """Per day and unregistered predicate, new facts; null days and predicates are left out."""
    rows = once(live(facts).select("id", "predicate", "created_at")).filter("created_at is not null and predicate is not null")
    return rows.join(predicates.select("predicate"), "predicate", "left_anti").groupBy(day("created_at").alias("day"), "predicate").agg(rows_as("facts"))


def confidence_buckets(log: DataFrame) -> DataFrame:
    c = F.col("primary_confidence")
    bucket = F.when(c < 0.2, "0.0-0.2").when(c < 0.4, "0.2-0.4").when(c < 0.6, "0.4-0.6").when(c < 0.8, "0.6-0.8").otherwise("0.8-1.0")
    return once(log.select("id", "primary_class", "primary_confidence")).groupBy("primary_class", bucket.alias("bucket")).agg(rows_as("n"))


def class_distribution(log: DataFrame) -> DataFrame:
    return once(log.select("id", "namespace", "primary_class")).groupBy("namespace", "primary_class").agg(rows_as("n"))


def parser_health(episodes: DataFrame) -> DataFrame:
    rows = episodes_once(episodes, "ingestion_mode", "parser_version", "parser_source_schema").filter("ingestion_mode = 'vendor_import'")
    return rows.groupBy("parser_version", "parser_source_schema").agg(rows_as("episodes"), F.date_format(F.max("ingested_at"), "yyyy-MM-dd HH:mm:ss").alias("last_ingested"))


def ingestion_distribution(episodes: DataFrame) -> DataFrame:
    """Count and percentage per namespace and mode."""
    from pyspark.sql import Window

    n = episodes_once(episodes, "namespace", "ingestion_mode").groupBy("namespace", "ingestion_mode").agg(rows_as("episodes"))
    return n.withColumn("pct", F.round(100.0 * F.col("episodes") / F.sum("episodes").over(Window.partitionBy("namespace")), 4))


def seed_only_namespaces(episodes: DataFrame) -> DataFrame:
    rows = episodes_once(episodes, "namespace", "ingestion_mode").groupBy("namespace").agg(F.every(F.col("ingestion_mode") == "user_authored_seed").alias("only"), rows_as("episodes"))
    return rows.filter("only").drop("only")


def queue_counters(episodes: DataFrame) -> DataFrame:
    s = F.col("processing_status")
    return episodes_once(episodes, "namespace", "processing_status").groupBy("namespace").agg(*[count_if(s == v, v) for v in ("pending", "processing", "completed", "failed")])


def completions_per_minute(episodes: DataFrame) -> DataFrame:
    """Tumbling minutes of processing completions."""
    rows = episodes_once(episodes, "processing_status", "processing_last_attempt").filter("processing_status = 'completed' and processing_last_attempt is not null")
    return rows.groupBy(F.date_format(F.window("processing_last_attempt", "1 minute")["start"], "yyyy-MM-dd HH:mm").alias("minute")).agg(rows_as("completions"))


def stage_medians(log: DataFrame, last: int = 60) -> DataFrame:
    """Median of each stage over the most recent compilations of a namespace."""
    rows = latest(once(log.select("id", "namespace", "created_at", *STAGES)), ["namespace"], [F.desc("created_at"), F.desc("id")], last)
    return rows.groupBy("namespace").agg(*[F.round(F.percentile(c, 0.5), 6).alias(c.replace("latency", "p50")) for c in STAGES])


def nearest_rank(log: DataFrame, last: int = 50) -> DataFrame:
    """sorted[min(n - 1, floor(p n))] of latency, median tokens: the dashboard's percentiles, over the most recent compilations."""
    rows = latest(once(log.select("id", "namespace", "created_at", "latency_total_ms", "compiled_tokens")), ["namespace"], [F.desc("created_at"), F.desc("id")], last)
    at = lambda a, p: F.get(a, F.least(F.size(a) - 1, F.floor(F.size(a) * F.lit(p))).cast("int"))
    lists = rows.groupBy("namespace").agg(F.sort_array(F.collect_list("latency_total_ms")).alias("l"), F.sort_array(F.collect_list("compiled_tokens")).alias("t"))
    return lists.select("namespace", at(F.col("l"), 0.5).alias("p50"), at(F.col("l"), 0.95).alias("p95"), at(F.col("t"), 0.5).alias("median_tokens"))


def fact_clusters(facts: DataFrame, least: int = 10) -> DataFrame:
    """Subjects with many live facts that nothing replaced; predicates as one sorted list."""
    rows = once(live(facts).filter("superseded_by is null").select("id", "namespace", "subject_id", "predicate")).withColumn("subject_id", F.lower("subject_id"))
    return rows.groupBy("namespace", "subject_id").agg(rows_as("facts"), F.array_join(F.sort_array(F.collect_set("predicate")), ",").alias("predicates")).filter(F.col("facts") >= least)


def extraction_metrics(facts: DataFrame, predicates: DataFrame) -> DataFrame:
    """Per episode: facts by strength and by registered or own predicate.  The registry is a small dimension."""
    known = predicates.select("predicate", F.lit(True).alias("known"))
    rows = once(live(facts).select("id", "predicate", "evidence_strength", "source_episodes")).withColumn("episode_id", F.explode(F.array_distinct(F.transform("source_episodes", F.lower)))).filter("episode_id is not null")
    return rows.join(known, "predicate", "left").groupBy("episode_id").agg(
        rows_as("facts"), count_if(F.col("evidence_strength") == "explicit", "explicit"), count_if(F.col("evidence_strength") == "implied", "implied"),
        count_if(F.col("known"), "canonical"), count_if(F.col("known").isNull(), "custom"))


def candidate_occurrences(facts: DataFrame, predicates: DataFrame, examples: int = 3) -> DataFrame:
    """Unregistered predicates with their number and the least ids as examples (bounded per task before the shuffle)."""
    rows = once(live(facts).select("id", "predicate")).filter("predicate is not null").join(predicates.select("predicate"), "predicate", "left_anti")
    few = latest(rows, ["predicate"], [F.asc("id")], examples).groupBy("predicate").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("examples"))
    return rows.groupBy("predicate").agg(rows_as("occurrences")).join(few, "predicate")


def predicate_usage(facts: DataFrame, predicates: DataFrame) -> DataFrame:
    """Registry with use counts, 0 for unused ones."""
    n = once(live(facts).select("id", "predicate")).groupBy("predicate").agg(rows_as("n"))
    return predicates.select("predicate", "category", "pack").join(n, "predicate", "left").select("predicate", "category", "pack", F.coalesce("n", F.lit(0)).alias("uses"))


def packs_with_counts(facts: DataFrame, predicates: DataFrame) -> DataFrame:
    return predicate_usage(facts, predicates).groupBy("pack").agg(F.count("predicate").alias("predicates"), F.sum("uses").alias("uses"))


def format_summary(log: DataFrame) -> DataFrame:
    """Means per output format and model."""
    rows = once(log.select("id", "output_format", "target_model", "candidates_found", "candidates_selected", "compiled_tokens", "latency_total_ms"))
    return rows.groupBy("output_format", F.coalesce("target_model", F.lit("none")).alias("target_model")).agg(
        rows_as("n"), F.round(F.avg(share(F.col("candidates_selected").cast("double"), F.col("candidates_found"))), 6).alias("precision"),
        F.round(F.avg("compiled_tokens"), 6).alias("tokens"), F.round(F.avg(F.when(F.col("latency_total_ms") >= 0, F.col("latency_total_ms"))), 6).alias("latency"))


def latest_compilations(log: DataFrame, n: int = 5) -> DataFrame:
    """The newest compilations of each namespace."""
    rows = latest(once(log.select("id", "namespace", "created_at", "primary_class", "compiled_tokens")), ["namespace"], [F.desc("created_at"), F.desc("id")], n)
    return rows.select("namespace", "rank", "id", "primary_class", "compiled_tokens")


def namespaces(episodes: DataFrame, entities: DataFrame, facts: DataFrame, log: DataFrame) -> DataFrame:
    """Distinct union, with the number of tables that have the namespace."""
    each = [t.select("namespace").distinct() for t in (episodes, entities, facts, log)]
    out = each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])
    return out.groupBy("namespace").agg(rows_as("tables"))
