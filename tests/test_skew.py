"""A tender holding a third of all bids: exact results, work spread out."""
from pyspark.sql import functions as F

import os

from conftest import SF_SMALL
from pliego.operators.bids import bid_stats
from pliego.operators.skew import hot_keys, join_unique_dim, kept_keys
from pliego.plans.views import bids_view, tender_view

# Rows from which on a task is one that reads the facts.
FACTS = 3000
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def skewed_bids(spark):
    b = bids_view(spark, SF_SMALL)
    # every third order's bids are moved onto tender 0
    return b.withColumn("tender_key", F.when(F.col("tender_key") % 3 == 0, F.lit(0).cast("bigint"))
                        .otherwise(F.col("tender_key")))


def test_hot_tender_gives_exact_results(spark):
    b, t = skewed_bids(spark), tender_view(spark, SF_SMALL)
    n_hot = b.where("tender_key = 0").count()
    assert n_hot > b.count() / 4
    salted = {tuple(r) for r in bid_stats(b, t, hot_rows=100).collect()}
    plain = {tuple(r) for r in bid_stats(b, t, hot_rows=10**12).collect()}
    assert salted == plain
    assert [r.NF018 for r in bid_stats(b, t, hot_rows=100).where("tender_key = 0").collect()] == [n_hot]


def test_hot_tender_is_spread_over_partitions(spark):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        b, t = skewed_bids(spark), tender_view(spark, SF_SMALL)
        j = join_unique_dim(b.select("tender_key", "bid_ts", "l_linenumber", "l_partkey"),
                            t.select("tender_key", "close_ts"), "tender_key", hot_rows=100)
        parts = j.where("tender_key = 0").select(F.spark_partition_id().alias("p")).distinct().count()
        plain = b.join(t.select("tender_key", "close_ts"), "tender_key").where("tender_key = 0") \
                 .select(F.spark_partition_id().alias("p")).distinct().count()
        assert plain == 1 and parts >= 4
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def shuffled_records(spark, run, tmp_path) -> int:
    """Records that the run's stages write to shuffles, by Spark's own stage metrics in its event log."""
    import json
    import subprocess
    import sys
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true")
         .config("spark.eventLog.dir", "file:{tmp_path}").config("spark.eventLog.rolling.enabled", "false").config("spark.sql.adaptive.enabled", "false").config("spark.sql.autoBroadcastJoinThreshold", "-1")
         .config("spark.eventLog.compress", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
from pyspark.sql import functions as F
from pliego.operators.skew import kept_keys
from pliego.operators.bids import bid_stats
from pliego.plans.views import bids_view, tender_view
t, b = tender_view(spark, {SF_SMALL!r}).where("method = '1-URGENT'"), bids_view(spark, {SF_SMALL!r})
{run}
bid_stats(b, t).write.format("noop").mode("overwrite").save()
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True)
    (log,) = tmp_path.iterdir()
    facts: dict[int, int] = {}  # of stages that read the facts' file: rows written
    for line in log.open():
        e = json.loads(line)
        if e["Event"] == "SparkListenerTaskEnd" and (read := e["Task Metrics"]["Input Metrics"])["Bytes Read"] and read["Records Read"] >= FACTS:
            k = e["Stage ID"]
            facts[k] = facts.get(k, 0) + e["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Records Written"]
    return max(facts.values())


def test_filter_cuts_what_is_shuffled(spark, tmp_path):
    """The facts that are shuffled fall to the kept tenders' share; results stay the same."""
    (tmp_path / "all").mkdir()
    (tmp_path / "kept").mkdir()
    b, t = bids_view(spark, SF_SMALL), tender_view(spark, SF_SMALL).where("method = '1-URGENT'")
    kept = b.join(t, "tender_key", "left_semi").count()
    everything = shuffled_records(spark, "", tmp_path / "all")
    cut = shuffled_records(spark, "b = kept_keys(b, t, 'tender_key')", tmp_path / "kept")
    assert everything == b.count() and kept <= cut < kept * 1.01 + 10 and cut < everything / 3
    assert {tuple(r) for r in bid_stats(b, t).collect()} == {tuple(r) for r in bid_stats(kept_keys(b, t, "tender_key"), t).collect()}


def test_filter_holds_every_key(spark):
    """Small bitmaps let more pass, never less; null keys go, text keys work, no tenders leave nothing."""
    facts = spark.createDataFrame([(str(i) if i % 7 else None,) for i in range(500)], "k string")
    dims = spark.createDataFrame([(str(i),) for i in range(0, 500, 11)] + [(None,)], "k string")
    want = {r.k for r in facts.join(dims, "k", "left_semi").collect()}
    for bits in (64, 1024, 1 << 16):
        got = {r.k for r in kept_keys(facts, dims, "k", bits).collect()}
        assert want <= got and (bits > 64 or len(got) > len(want)) and (bits < 1 << 16 or got == want)
    assert kept_keys(facts, dims.limit(0), "k").count() == 0


def test_hot_keys_by_sketch(spark):
    """All keys over the limit are found, and the list is bounded whatever the facts."""
    from pliego.operators import skew
    facts = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, 8).otherwise(F.col("id")).alias("k"))
    hot = {r.k: r._salts for r in hot_keys(facts, "k", 5000).collect()}
    assert hot == {7: 7, 8: 2}
    assert hot_keys(spark.range(50_000).select((F.col("id") % 25_000).alias("k")), "k", 1).count() <= skew.MAX_HOT
    assert "Exchange hashpartitioning" not in hot_keys(facts, "k")._jdf.queryExecution().executedPlan().toString()
    assert hot_keys(facts.limit(0), "k").count() == 0 and hot_keys(facts.select(F.lit(None).cast("int").alias("k")), "k").count() == 0
