"""Retrieval: exact vector search in tiles, keyword match, bounded graph traversal."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.common import latest, live, once
from tidemark.operators.memory import AS_OF, facts_once

QUERIES, VECTORS = 4096, 16_384  # rows of a tile on either side


def _matrix(vectors: pd.Series) -> np.ndarray:
    m = np.array([np.asarray(v, float) for v in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, least: float = -1.0, same: str | None = None, tile: tuple[int, int] = (QUERIES, VECTORS)) -> DataFrame:
    """``query_id, vec_id, similarity, rank``: the k most similar vectors of each query by cosine, exact, without the query itself.

    ``vectors`` and ``queries`` have vec_id, embedding (and ``same``, a label that must agree).  Both are cut into tiles by a hash of the id; Spark
    brings each pair of tiles together, one product of two bounded matrices, which keeps k rows per query.  Vectors travel once per
    tile of queries and queries once per tile of vectors; nothing passes through the driver.  Null or empty vectors are left out, zero
    vectors have similarity 0; ties go to the lesser id.
    """
    cols = ["vec_id", "embedding", *([same] if same else [])]
    usable = lambda df: df.select(*cols).filter("size(embedding) > 0 and vec_id is not null")
    tiles = lambda df, rows: max(1, math.ceil(df.count() / rows))
    vectors, queries = usable(vectors), usable(queries)
    nq, nv = tiles(queries, tile[0]), tiles(vectors, tile[1])
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    q_cols = [f"q_{c}" for c in cols]  # both sides may be one table
    left = queries.withColumn("__q", own(nq)).withColumn("__v", every(nv)).toDF(*q_cols, "__q", "__v").groupBy("__q", "__v")
    right = vectors.withColumn("__v", own(nv)).withColumn("__q", every(nq)).groupBy("__q", "__v")

    def score(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []})
        q_ids, v_ids = q["q_vec_id"].to_numpy(), v["vec_id"].to_numpy()
        s = np.round(_matrix(q["q_embedding"]) @ _matrix(v["embedding"]).T, 6)
        s[q_ids[:, None] == v_ids[None, :]] = -2
        if same:
            s[q[f"q_{same}"].to_numpy()[:, None] != v[same].to_numpy()[None, :]] = -2
        keep = min(k, s.shape[1])
        kth = -np.partition(-s, keep - 1, axis=1)[:, keep - 1]
        i, j = np.nonzero((s >= kth[:, None]) & (s >= least) & (s > -2))  # ties of the k-th stay in
        return pd.DataFrame({"query_id": q_ids[i], "vec_id": v_ids[j], "similarity": s[i, j]})

    found = left.cogroup(right).applyInPandas(score, "query_id bigint, vec_id bigint, similarity double")
    return latest(found, ["query_id"], [F.desc("similarity"), F.asc("vec_id")], k)


def knn(embeddings: DataFrame, k: int = 10) -> DataFrame:
    """Every vector whose id is divisible by 50 against all."""
    return nearest(embeddings, embeddings.filter("vec_id % 50 = 0"), k)


def resolve_semantic(embeddings: DataFrame, least: float = 0.92, gap: float = 0.03) -> DataFrame:
    """Merge, conflict or new for each query vector among its label's: the top similarity must reach ``least`` and lead by ``gap``."""
    top = nearest(embeddings, embeddings.filter("vec_id % 50 = 0"), 10, same="label")
    w = Window.partitionBy("query_id").orderBy("rank")
    rows = top.withColumn("second", F.coalesce(F.lead("similarity").over(w), F.lit(0.0))).withColumn("near", F.count(F.when(F.col("similarity") > F.first("similarity").over(w) - gap, 1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    best = rows.filter("rank = 1")
    method = F.when(F.col("similarity") < least, "new").when(F.round(F.col("similarity") - F.col("second"), 6) >= gap, "merge").otherwise("conflict")
    return best.select("query_id", method.alias("method"), F.when(method == "merge", F.col("vec_id")).alias("target"), "similarity", F.when(method == "conflict", F.col("near")).otherwise(0).cast("bigint").alias("candidates"))


def conflicts(embeddings: DataFrame, least: float = 0.92, gap: float = 0.03) -> DataFrame:
    """``query_id, candidates``: of query vectors whose best matches are too close to tell apart, those matches as JSON, best first."""
    top = nearest(embeddings, embeddings.filter("vec_id % 50 = 0"), 10, same="label")
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = top.withColumn("best", F.first("similarity").over(w)).filter((F.col("best") >= least) & (F.col("similarity") > F.col("best") - gap))
    one = F.format_string('{"id":%d,"score":%.6f,"method":"semantic"}', "vec_id", "similarity")
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("j")))).alias("x")).filter("size(x) > 1").select("query_id", F.concat(F.lit("["), F.array_join(F.transform("x", lambda r: r["j"]), ","), F.lit("]")).alias("candidates"))


def recency(at, as_of: str = AS_OF):
    """exp(-age ln 2 / 30) with the age in days of whole hours, at least 0."""
    hours = F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))) / 3600)
    return F.exp(-F.greatest(hours / 24.0, F.lit(0.0)) * F.log(F.lit(2.0)) / 30)


def episode_recall(documents: DataFrame, embeddings: DataFrame, k: int = 10) -> DataFrame:
    """The top k by cosine among texts that have a vector, then scored 0.7 similarity + 0.3 recency, at most 1."""
    have = embeddings.join(documents.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    top = nearest(have, embeddings.filter("vec_id % 50 = 0"), k)
    rows = top.join(documents.groupBy(F.col("doc_id").alias("vec_id")).agg(F.min("created_at").alias("created_at")), "vec_id")
    return rows.select("query_id", F.col("vec_id").alias("doc_id"), "rank", F.round(F.least(F.lit(1.0), 0.7 * F.col("similarity") + 0.3 * F.coalesce(recency(F.col("created_at")), F.lit(0.0))), 5).alias("score"))


def query_terms(log: DataFrame) -> DataFrame:
    """Distinct lower-case terms of at least three bytes per namespace."""
    terms = F.filter(F.split(F.lower("query_text"), r"\s+"), lambda x: F.octet_length(x) >= 3)
    return log.select("namespace", F.explode(terms).alias("term")).distinct()


def _grams(c: str):
    """Trigrams, and those of one and two characters that are as long as a term in bytes (none in ASCII)."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda i: F.substring(F.col(c), i, n))
    short = F.filter(F.concat(of(1), of(2)), lambda g: F.octet_length(g) >= 3)
    return F.array_distinct(F.concat(of(3), short))


def term_entities(log: DataFrame, entities: DataFrame) -> DataFrame:
    """``namespace, term, name, entity_id``: for each term of a namespace's queries every entity whose name contains it.

    Terms meet names through the rarest of their trigrams in the namespace (a shorter term through all of itself), an equi-join on (namespace, gram), and
    are then checked as a whole; so common beginnings bring nothing together, and a term with a trigram that no name has drops out at once.
    """
    names = once(live(entities).select("id", "name", "namespace")).withColumn("low", F.lower("name"))
    grams = names.withColumn("gram", F.explode(_grams("low")))
    known = grams.groupBy("namespace", "gram").agg(F.count(F.lit(1)).alias("c"))
    long = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("term") - 2)), lambda i: F.substring(F.col("term"), i, 3))
    parts = query_terms(log).withColumn("gs", F.array_distinct(long)).withColumn("need", F.size("gs"))
    parts = parts.select("namespace", "term", "need", F.explode("gs").alias("gram")).join(known, ["namespace", "gram"])
    best = parts.groupBy("namespace", "term", "need").agg(F.min(F.struct("c", "gram")).alias("x"), F.count(F.lit(1)).alias("n")).filter("n = need")
    hit = best.select("namespace", "term", F.col("x.gram").alias("gram")).join(grams, ["namespace", "gram"]).filter(F.contains("low", "term"))
    return hit.select("namespace", "term", "name", F.lower("id").alias("entity_id"))


def keyword_entities(log: DataFrame, entities: DataFrame, most: int = 5) -> DataFrame:
    """For each term of a namespace's queries the first entities whose name contains it (by name, then id)."""
    return latest(term_entities(log, entities), ["namespace", "term"], [F.asc("name"), F.asc("entity_id")], most)


def edges(facts: DataFrame) -> DataFrame:
    """Current facts in both directions: ``namespace, a, b, fact_id``.  Facts of an entity with itself lead nowhere."""
    f = facts_once(facts, "namespace", "subject_id", "object_id", "valid_until").filter("valid_until is null and subject_id <> object_id")
    return f.select("namespace", F.col("subject_id").alias("a"), F.col("object_id").alias("b"), F.col("id").alias("fact_id")).unionByName(
        f.select("namespace", F.col("object_id").alias("a"), F.col("subject_id").alias("b"), F.col("id").alias("fact_id")))


def seeds(entities: DataFrame) -> DataFrame:
    """The stated query set: live entities whose id's last four hexadecimal digits are a number divisible by 50."""
    ids = once(live(entities).select("id", "namespace")).select(F.lower("id").alias("seed"), "namespace")
    return ids.filter(F.conv(F.substring("seed", -4, 4), 16, 10).cast("bigint") % 50 == 0)


def traverse(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """``seed, entity_id, hop, paths``: entities within two hops of each seed over current facts of its namespace, with the number of paths that
    visit no entity twice.  Targets must be live.  Two unrolled joins; steps to one entity are counted before the second."""
    e = edges(facts)
    alive = once(live(entities).select("id")).select(F.lower("id").alias("b"))
    e = e.join(alive, "b", "left_semi").groupBy("namespace", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    one = seeds(entities).withColumnRenamed("seed", "a").join(e, ["namespace", "a"]).select("namespace", F.col("a").alias("seed"), F.col("b").alias("mid"), F.col("n").alias("n1"))
    two = one.join(e.select("namespace", F.col("a").alias("mid"), "b", "n"), ["namespace", "mid"]).filter("b <> seed")
    return one.select("seed", F.col("mid").alias("entity_id"), F.lit(1).alias("hop"), F.col("n1").alias("paths")).unionByName(
        two.groupBy("seed", F.col("b").alias("entity_id")).agg(F.sum(F.col("n1") * F.col("n")).alias("paths")).select("seed", "entity_id", F.lit(2).alias("hop"), "paths"))


def walks(facts: DataFrame, entities: DataFrame, max_hops: int = 2) -> DataFrame:
    """``seed, entity_id, hop, path, facts``: every way of at most ``max_hops`` steps from a seed that visits no entity twice, with the entities and
    the facts along it.  Current facts of the seed's namespace, both directions, live targets; an entity comes once for each way to it.

    One join per hop; adaptive execution splits the partitions of hubs.  The last step is joined late, so a way is not widened before it is final.
    """
    alive = once(live(entities).select("id")).select(F.lower("id").alias("b"))
    e = edges(facts).join(alive, "b", "left_semi").select("namespace", F.col("a").alias("at"), "b", F.lower("fact_id").alias("fact_id"))
    none = F.array().cast("array<string>")
    step = seeds(entities).select("namespace", "seed", F.col("seed").alias("at"), F.array("seed").alias("path"), none.alias("facts"))
    out = None
    for hop in range(1, max_hops + 1):
        step = step.join(e, ["namespace", "at"]).filter(~F.array_contains("path", F.col("b")))
        step = step.select("namespace", "seed", F.col("b").alias("at"), F.concat("path", F.array("b")).alias("path"), F.concat("facts", F.array("fact_id")).alias("facts"))
        rows = step.select("seed", F.col("at").alias("entity_id"), F.lit(hop).alias("hop"), "path", "facts")
        out = rows if out is None else out.unionByName(rows)
    return out


def walk_rows(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """The ways of one and two hops as text."""
    return walks(facts, entities).select("seed", "entity_id", "hop", F.array_join("path", ">").alias("path"), F.array_join("facts", ">").alias("facts"))


def graph_edges(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """``seed, fact_id, subject_id, predicate, object_id, hop``: the graph around each seed, every fact on a way of two hops once, at its least hop."""
    on = walks(facts, entities).select("seed", F.posexplode("facts").alias("hop", "fact_id")).groupBy("seed", "fact_id").agg((F.min("hop") + 1).alias("hop"))
    f = facts_once(facts, "subject_id", "predicate", "object_id").select(F.lower("id").alias("fact_id"), "subject_id", "predicate", "object_id")
    return on.join(f, "fact_id").select("seed", "fact_id", "subject_id", "predicate", "object_id", "hop")


def neighborhood(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Per seed one hop, or two where one hop has fewer than three paths; each entity once at its least hop, scored 0.9 or 0.7."""
    t = traverse(facts, entities)
    w = Window.partitionBy("seed")
    t = t.withColumn("ones", F.sum(F.when(F.col("hop") == 1, F.col("paths")).otherwise(0)).over(w)).filter("hop = 1 or ones < 3")
    best = t.groupBy("seed", "entity_id").agg(F.min("hop").alias("hop"))
    return best.select("seed", "entity_id", "hop", F.when(F.col("hop") == 1, 0.9).otherwise(0.7).alias("score"))


def fact_lookup(log: DataFrame, facts: DataFrame, entities: DataFrame, most: int = 20) -> DataFrame:
    """``namespace, term, fact_id, score, rank``: per query term the best current facts about the entities it names.

    The score is the fact's confidence (0.5 without) plus 0.05 for each end that the term names, at most 1; ties go to the lesser id.
    All entities a term names take part; the only cut is the one at rank ``most``.
    """
    hit = term_entities(log, entities).select("namespace", "term", F.col("entity_id").alias("e"))
    f = facts_once(facts, "namespace", "subject_id", "object_id", "valid_until", "properties").filter("valid_until is null")
    conf = F.coalesce(F.get_json_object("properties", "$.confidence").cast("double"), F.lit(0.5))
    ends = f.select("namespace", F.col("id").alias("fact_id"), conf.alias("c"), F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("e")).filter("e is not null")
    rows = hit.join(ends, ["namespace", "e"]).groupBy("namespace", "term", "fact_id").agg(F.max("c").alias("c"), F.count(F.lit(1)).alias("n"))
    rows = rows.select("namespace", "term", "fact_id", F.round(F.least(F.lit(1.0), F.col("c") + F.least(F.lit(0.1), 0.05 * F.col("n"))), 6).alias("score"))
    return latest(rows, ["namespace", "term"], [F.desc("score"), F.asc("fact_id")], most)


# The retrieval profiles of a task class.
PROFILES = {"debug": ["graph_neighborhood", "episode_recall"], "architecture": ["fact_lookup", "graph_neighborhood"], "compliance": ["episode_recall", "fact_lookup"], "writing": ["fact_lookup"], "chat": ["fact_lookup"]}


def merge_profiles(log: DataFrame) -> DataFrame:
    """Per pair of classes the profiles to run (the first's, then what the second adds, three at most) and how often just these ran."""
    rows = once(log.select("id", "primary_class", "secondary_class", "profiles_executed"))
    none = F.array().cast("array<string>")
    of = lambda c: F.coalesce(F.create_map(*[x for k, v in PROFILES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.coalesce(c, F.lit(""))], none)
    plan = F.slice(F.array_distinct(F.concat(of(F.col("primary_class")), of(F.col("secondary_class")))), 1, 3)
    rows = rows.withColumn("planned", F.array_join(plan, ",")).withColumn("ran", F.array_join(F.coalesce("profiles_executed", none), ","))
    return rows.groupBy("primary_class", F.coalesce("secondary_class", F.lit("none")).alias("secondary"), "planned").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("planned") == F.col("ran"), 1)).alias("as_planned"))


def predicate_blocks(facts: DataFrame, predicates: DataFrame) -> DataFrame:
    """Per pack one text with a line per category: its predicates in order with the number of facts that use them."""
    n = facts_once(facts, "predicate").groupBy("predicate").agg(F.count(F.lit(1)).alias("uses"))
    rows = predicates.filter("predicate is not null").select("predicate", "category", "pack").join(n, "predicate", "left").fillna(0, ["uses"])
    word = F.concat("predicate", F.lit(" ("), F.col("uses").cast("string"), F.lit(")"))
    lines = rows.groupBy("pack", "category").agg(F.array_join(F.array_sort(F.collect_list(word)), ", ").alias("words"))
    line = F.concat("category", F.lit(": "), "words")
    return lines.groupBy("pack").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("block"))
