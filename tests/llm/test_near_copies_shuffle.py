"""What the pipeline's near-dedup stage deals out for texts that share nothing, and for those that share a band only."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from corvid.llm import nearcopies


def _written(spark):
    """Bytes of shuffle that the session has written."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_keys_of_one_text_are_dealt_out_once(spark, sf):
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(3000)]
    texts += [f"{t} x" for t in texts[:30]]  # near copies
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        before = _written(spark)
        assert dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, sf).count() == 3000
        each = (_written(spark) - before) / len(texts)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert each < 3000  # the sketch once, 64 keys with their node once


def test_no_shared_key_is_lost(spark):
    r = np.random.default_rng(7)
    keys = r.integers(-(2**63), 2**63 - 1, (2000, nearcopies.BANDS), dtype=np.int64)
    for i in range(0, 1000, 2):  # neighbours share one band, each time another; some keys are negative
        keys[i + 1, i // 2 % nearcopies.BANDS] = keys[i, i // 2 % nearcopies.BANDS]
    rows = [(i, 9, b"x" * 320, k) for i, k in enumerate(keys.tolist())] + [(2000, 0, b"", [])]
    one = spark.createDataFrame(rows, "node long, n long, low binary, keys array<long>")
    heads = nearcopies._heads(one)
    expected = {(keys[i, i // 2 % nearcopies.BANDS].item(), i) for i in range(0, 1000, 2)}
    assert {tuple(x) for x in heads.select("key", "head").collect()} == expected
    met = nearcopies._met(one, heads)
    bucket = met.select("node", F.explode("shared").alias("key")).join(heads, "key").select("key", "node").collect()
    assert {tuple(x) for x in bucket} == {(k, i + d) for k, i in expected for d in (0, 1)} and len(bucket) == 1000
    assert all(set(x.shared) <= set(keys[x.node].tolist()) and bytes(x.low) == b"x" * 320 for x in met.collect()) and met.count() < 1100
