"""Candidates of several profiles: union, exclusion of what is shown anyway, removal of repeats, ranking and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.common import episodes_once, live, once
from tidemark.operators.memory import facts_once, fact_ends
from tidemark.operators.ranking import AUTHORITY, ITEM_TOKENS, xml_escape
from tidemark.operators.retrieval import recency, seeds, walks
from tidemark.session import shared_dir


def retrieved(facts: DataFrame, entities: DataFrame, episodes: DataFrame) -> DataFrame:
    """``seed, profile, kind, id, relevance, recency, stability``: what three profiles find about each seed entity, one after the other.

    0: current facts about it, by confidence (0.5 without); 1: facts at the end of a way of one or two hops, 0.9 or 0.7; 2: episodes that
    its facts cite.  A fact may come from several profiles and ways.
    """
    s = seeds(entities).select("namespace", F.col("seed").alias("e"))
    about = fact_ends(facts).join(s, ["namespace", "e"]).select(F.col("e").alias("seed"), "fact_id")
    f = facts_once(facts, "properties", "evidence_status", "source_episodes").select(F.lower("id").alias("fact_id"), F.coalesce(F.get_json_object("properties", "$.confidence").cast("double"), F.lit(0.5)).alias("c"), "evidence_status", "source_episodes")
    authority = F.coalesce(*[F.when(F.col("evidence_status") == k, F.lit(v)) for k, v in AUTHORITY.items()], F.lit(0.5))
    known = about.join(f, "fact_id")
    facts_ = known.select("seed", F.lit(0).alias("profile"), F.lit("fact").alias("kind"), F.col("fact_id").alias("id"), "c", F.lit(0.6).alias("recency"), (0.6 + 0.3 * authority).alias("stability"))
    hop = lambda one, two: F.when(F.col("hop") == 1, F.lit(one)).otherwise(F.lit(two))
    graph = walks(facts, entities).select("seed", F.lit(1).alias("profile"), F.lit("graph").alias("kind"), F.element_at("facts", -1).alias("id"), hop(0.9, 0.7).alias("c"), hop(0.8, 0.6).alias("recency"), hop(0.7, 0.5).alias("stability"))
    cited = known.select("seed", F.explode("source_episodes").alias("x")).select("seed", F.lower("x").alias("id")).dropna().distinct()
    texts = episodes_once(episodes, "occurred_at").select(F.lower("id").alias("id"), F.round(F.coalesce(recency(F.col("occurred_at")), F.lit(0.0)), 5).alias("recency"))
    episodes_ = cited.join(texts, "id").select("seed", F.lit(2).alias("profile"), F.lit("episode").alias("kind"), "id", F.lit(0.5).alias("c"), "recency", F.lit(0.8).alias("stability"))
    return facts_.unionByName(graph).unionByName(episodes_).withColumnRenamed("c", "relevance")


def scored(candidates: DataFrame) -> DataFrame:
    score = F.round(0.5 * F.col("relevance") + 0.25 * F.col("recency") + 0.25 * F.col("stability"), 7)
    return candidates.withColumn("score", score)


def deduplicated(candidates: DataFrame, hot: DataFrame) -> DataFrame:
    """``candidates`` without the ids in ``hot`` and with ``kept``: the first of each seed and id by profile, then score; others are repeats."""
    rest = candidates.join(hot.select("id").distinct(), "id", "left_anti")
    w = Window.partitionBy("seed", "id").orderBy("profile", F.desc("score"))
    return rest.withColumn("kept", F.row_number().over(w) == 1)


def hot_facts(facts: DataFrame) -> DataFrame:
    """Facts that are shown in any case: those a user asserted."""
    return facts_once(facts, "evidence_status").filter("evidence_status = 'user_asserted'").select(F.lower("id").alias("id"))


def repeats(facts: DataFrame, entities: DataFrame, episodes: DataFrame) -> DataFrame:
    """Per seed and kind, candidates kept and rejected as repeats."""
    rows = deduplicated(scored(retrieved(facts, entities, episodes)), hot_facts(facts))
    return rows.groupBy("seed", "kind").agg(F.count(F.when(F.col("kept"), 1)).alias("kept"), F.count(F.when(~F.col("kept"), 1)).alias("rejected"))


def union_counts(facts: DataFrame, entities: DataFrame, episodes: DataFrame) -> DataFrame:
    """Per seed and profile, candidates found and their best relevance."""
    return retrieved(facts, entities, episodes).groupBy("seed", "profile", "kind").agg(F.count(F.lit(1)).alias("found"), F.max("relevance").alias("best"))


def ranked(facts: DataFrame, entities: DataFrame, episodes: DataFrame) -> DataFrame:
    """``seed, rank, kind, id, score``: kept candidates by score; equal ones stay in the order of profiles, then ids."""
    rows = deduplicated(scored(retrieved(facts, entities, episodes)), hot_facts(facts)).filter("kept")
    w = Window.partitionBy("seed").orderBy(F.desc("score"), "profile", "id")
    return rows.withColumn("rank", F.row_number().over(w)).select("seed", "rank", "kind", "id", "score")


def audit_entries(facts: DataFrame, entities: DataFrame, episodes: DataFrame, budget: int = 500) -> DataFrame:
    """``seed, found, selected, rejected, tokens``: what a compilation of each seed would log when ranked candidates are taken until the budget is full.

    A running sum over the ranking; what begins beyond the budget is rejected.
    """
    cost = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in ITEM_TOKENS.items()])
    w = Window.partitionBy("seed").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranked(facts, entities, episodes).withColumn("cost", cost).withColumn("upto", F.sum(cost).over(w))
    fits = F.col("upto") <= budget
    return rows.groupBy("seed").agg(F.count(F.lit(1)).alias("found"), F.count(F.when(fits, 1)).alias("selected"), F.count(F.when(~fits, 1)).alias("rejected"), F.coalesce(F.sum(F.when(fits, F.col("cost"))), F.lit(0)).cast("bigint").alias("tokens"))


def packages(facts: DataFrame, entities: DataFrame, episodes: DataFrame, budget: int = 500) -> DataFrame:
    """``seed, context, tokens``: of each seed the ranked candidates that fit the budget, facts and episodes in sections of one text.

    A fact costs 50, one from the graph 30, an episode a quarter of its bytes, 20 to 200; a running sum over the ranking decides, so a text
    holds at most budget / 20 elements and nothing longer is gathered.  Tokens are 20 and a quarter of each element's bytes.
    Facts whose ends have no live entity are written with empty names.  What was chosen is small and read for facts and for episodes, so it is
    kept in the shared folder.
    """
    shared_dir(facts.sparkSession)
    n = once(live(entities).select("id", "name")).select(F.lower("id").alias("e"), "name")
    f = facts_once(facts, "subject_id", "predicate", "object_id", "evidence_status", "valid_from").select(F.lower("id").alias("id"), "subject_id", "predicate", "object_id", "evidence_status", "valid_from")
    text = lambda c: xml_escape(F.coalesce(c, F.lit("")))
    attr = lambda name, c: F.concat(F.lit(f' {name}="'), text(c), F.lit('"'))
    ep = episodes_once(episodes, "occurred_at", "source", "content").select(F.lower("id").alias("id"), "occurred_at", "source", "content")
    size = F.greatest(F.lit(20), F.least(F.lit(200), F.coalesce(F.floor(F.octet_length("content") / 4), F.lit(0))))
    costs = ep.select("id", size.alias("size"))
    cost = F.when(F.col("kind") == "episode", F.col("size")).when(F.col("kind") == "graph", 30).otherwise(50)
    w = Window.partitionBy("seed").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chosen = ranked(facts, entities, episodes).join(costs, "id", "left").withColumn("upto", F.sum(cost).over(w)).filter(F.col("upto") <= budget).select("seed", "rank", "kind", "id").checkpoint()
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    ends = chosen.filter("kind <> 'episode'").join(f, "id").join(n.toDF("subject_id", "s"), "subject_id", "left").join(n.toDF("object_id", "o"), "object_id", "left")
    fact = ends.select("seed", "rank", F.lit("facts").alias("part"), F.concat(F.lit("<fact"), attr("subject", F.col("s")), attr("predicate", F.col("predicate")), attr("object", F.col("o")), attr("evidence", F.col("evidence_status")), attr("observed", day("valid_from")), F.lit("/>")).alias("x"))
    said = chosen.filter("kind = 'episode'").join(ep, "id")
    episode = said.select("seed", "rank", F.lit("episodes").alias("part"), F.concat(F.lit("<episode"), attr("date", day("occurred_at")), attr("source", F.col("source")), F.lit(' id="'), "id", F.lit('">'), text(F.col("content")), F.lit("</episode>")).alias("x"))
    rows = fact.unionByName(episode).groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("rank", "part", "x"))).alias("xs"))
    part = lambda name: F.transform(F.filter("xs", lambda x: x["part"] == name), lambda x: x["x"])
    section = lambda name, tag: F.when(F.size(part(name)) > 0, F.concat(F.lit(f"<{tag}>\n"), F.array_join(part(name), "\n"), F.lit(f"\n</{tag}>\n"))).otherwise(F.lit(""))
    tokens = F.aggregate("xs", F.lit(20).cast("bigint"), lambda t, x: t + F.floor(F.octet_length(x["x"]) / 4))
    return rows.select("seed", F.concat(F.lit("<context>\n"), section("facts", "knowledge"), section("episodes", "episodes"), F.lit("</context>")).alias("context"), tokens.alias("tokens"))
