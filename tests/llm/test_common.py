from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from stepfold.llm import common


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_lookup_of_a_hot_key_is_a_plain_join(spark, how):
    # one key has 4,000 of 6,000 rows, some have no partner, some are null
    rows = spark.range(6000).select("id", F.when(F.col("id") < 4000, 7).when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 50 + 100).cast("int").alias("k")).repartition(3)
    table = common.cut(rows.filter("k < 130").groupBy("k").agg(F.count("*").alias("n")).withColumn("name", F.concat(F.lit("x"), F.col("k").cast("string"))))
    plan = common.lookup(rows, table, ["k"], "n", 6000, ["id"], how)
    want = rows.join(table.drop("n"), ["k"], how)
    assert plan.columns == want.columns and Counter(map(tuple, plan.collect())) == Counter(map(tuple, want.collect()))
    # without merging of small partitions and without a broadcast of the small table the key's rows lie in several tasks
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        dealt = common.lookup(rows, table, ["k"], "n", 6000, ["id"], how)
        held = [r["n"] for r in dealt.filter("k = 7").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(held) == 4000 and max(held) < 3000


def test_lookup_without_a_hot_key(spark):
    rows = spark.range(100).select("id", (F.col("id") % 5).alias("k"))
    table = common.cut(rows.groupBy("k").agg(F.count("*").alias("n")))
    assert common.lookup(rows, table, ["k"], "n", 100, ["id"]).count() == 100


def test_a_cluster_must_name_its_shared_folder():
    def session(master, **conf):
        sc = SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)))

    for master in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            common.shared_dir(session(master))
        assert common.shared_dir(session(master, **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    assert all("stepfold-" in common.shared_dir(session(m)) for m in ("local", "local[4]", "local[*]"))


def test_words_in_blocks_are_the_words():
    data = (b"a  bc\x0bd \x85e " * 50 + b"f" * 200) * 3
    assert [w for block in common.word_blocks(data, 64) for w in block] == data.split()
