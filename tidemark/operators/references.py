"""References between tables: missing, deleted and late targets.

References and parents are co-partitioned and sorted by target and merged in one sort-merge join.  A parent is the interval of its
validity, from when it was recorded until it was deleted; where a reference stands to it tells missing, deleted and late apart.
A target that very many references name is split by adaptive execution, which cuts its partition by size and reads the one parent
row for each part; parents are reduced to one row per target before, so no target is large on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.time import day_text, micros


def references(facts: DataFrame) -> DataFrame:
    """``fact_id, field, ref_table, ref_id, made_us`` of live facts; null references (also inside arrays) are none.

    Keys are lower-cased.  An empty array holds no reference; an element that stands twice in an array is one reference.
    """
    ref = lambda field, table, ids: F.struct(F.lit(field).alias("field"), F.lit(table).alias("ref_table"), ids.alias("ref_ids"))
    one = lambda c: F.array(F.lower(c))
    return (
        facts.filter(F.col("deleted_at").isNull())
        .select(
            F.col("id").alias("fact_id"), micros("created_at").alias("made_us"),
            F.explode(F.array(
                ref("subject_id", "loom_entities", one("subject_id")),
                ref("object_id", "loom_entities", one("object_id")),
                ref("superseded_by", "loom_facts", one("superseded_by")),
                ref("source_episodes", "loom_episodes", F.array_distinct(F.transform("source_episodes", F.lower))),
            )).alias("r"),
        )
        .select("fact_id", "made_us", "r.field", "r.ref_table", F.explode("r.ref_ids").alias("ref_id"))
        .filter("ref_id is not null")
    )


def parents(entities: DataFrame, episodes: DataFrame, facts: DataFrame) -> DataFrame:
    """``ref_table, ref_id, from_us, until_us`` of every row that can be referred to: recorded at, deleted at (null: not deleted)."""
    of = lambda df, name, at: df.select(F.lit(name).alias("ref_table"), F.lower("id").alias("ref_id"), at.alias("from_us"), micros("deleted_at").alias("until_us"))
    return (
        of(entities, "loom_entities", micros("created_at"))
        .unionByName(of(episodes, "loom_episodes", micros("ingested_at")))
        .unionByName(of(facts, "loom_facts", F.lit(None).cast("bigint")))
        .filter("ref_id is not null")
    )


def target(table: str = "ref_table", key: str = "ref_id"):
    """One sort key for both streams."""
    return F.concat_ws(":", table, key).alias("target")


def validity(rows: DataFrame) -> DataFrame:
    """``target, from_us, until_us, open``: one interval per target.  It begins at the earliest record among the rows that are not deleted and
    is open where there is one; otherwise it ends with the last deletion."""
    is_open = F.col("until_us").isNull()
    one = rows.groupBy("ref_table", "ref_id").agg(F.min(F.when(is_open, F.col("from_us"))).alias("from_us"), F.max("until_us").alias("until_us"), F.max(is_open).alias("open"))
    return one.select(target(), "from_us", F.when(~F.col("open"), F.col("until_us")).alias("until_us"), F.lit(True).alias("known"))


def merge_references(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """``refs`` with ``state``: missing (no interval), deleted (the interval has ended, at whatever time), late (it begins after the reference
    was made; unknown times are not late), ok."""
    state = (
        F.when(F.col("known").isNull(), "missing").when(F.col("until_us").isNotNull(), "deleted")
        .when(F.col("from_us") > F.col("made_us"), "late").otherwise("ok")
    )
    # grouped by (table, id) but joined by target: both sides of the join are shuffles of their own, which adaptive execution can split
    return refs.withColumn("target", target()).join(validity(rows).hint("merge"), "target", "left").withColumn("state", state).drop("target", "from_us", "until_us", "known")


def orphans(facts: DataFrame, entities: DataFrame, episodes: DataFrame) -> DataFrame:
    """Every reference that is not ok, once: ``fact_id, field, ref_table, ref_id, made_us, state``."""
    return merge_references(references(facts), parents(entities, episodes, facts)).filter("state <> 'ok'").dropDuplicates(["fact_id", "field", "ref_id"])


def found(facts: DataFrame, entities: DataFrame, episodes: DataFrame) -> DataFrame:
    return orphans(facts, entities, episodes).select("fact_id", "field", "ref_id")


def by_table_and_day(facts: DataFrame, entities: DataFrame, episodes: DataFrame) -> DataFrame:
    """``ref_table, day, state, orphans``; day is that of the fact's created_at, null where it has none."""
    return orphans(facts, entities, episodes).groupBy("ref_table", day_text("made_us").alias("day"), "state").agg(F.count(F.lit(1)).alias("orphans"))
