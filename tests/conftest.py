from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import get_session

    s = get_session(master="local[4]", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir("file://" + str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


TABLES = sorted(p.stem for p in Path(SF).glob("*.parquet"))
CLASHING = ["rank", "n", "k", "e", "grp", "salt", "slot", "state", "keep", "keys", "items", "us", "w", "seed", "hop", "field"]


@pytest.fixture(scope="session")
def dirty(spark, tmp_path_factory):
    """Few rows, each twice, one row of nulls alone, and extra columns named as operators name theirs."""
    d = tmp_path_factory.mktemp("dirty")
    for name in TABLES:
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        few = df.limit(120).cache()
        nulls = spark.createDataFrame([tuple(None for _ in few.columns)], few.schema)
        out = few.unionByName(nulls) if name in ("loom_predicates", "mix_targets", "eval_items", "events", "embeddings") else few.unionByName(few.limit(15)).unionByName(nulls)
        for c in CLASHING:
            if c not in out.columns:
                out = out.withColumn(c, F.lit("x"))
        out.coalesce(1).write.parquet(f"{d}/{name}.parquet")
        few.unpersist()
    return str(d)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for name in TABLES:
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return str(d)
