"""The check of changed entries against a full check, through random edits."""

import random

from pyspark.sql import functions as F

from vellum.operators import check, recheck
from vellum.plans.papers import paper_records


def test_equal_to_a_full_check(spark, sf, tmp_path):
    rng, root = random.Random(2), str(tmp_path)
    papers = paper_records(spark, sf).drop("doc_id").limit(60).cache()
    keys = sorted(r["dir_key"] for r in papers.collect())
    files = {(k, n, d) for k in keys for n, d in (("paper.json", False), ("v1", False), ("src", True)) if rng.random() < 0.8}
    state = {k: None for k in keys}
    touched = []
    for turn in range(3):
        rows = papers.where(F.col("dir_key").isin([k for k in state])).withColumn("pending", F.coalesce(F.create_map(*(F.lit(x) for k, v in state.items() for x in (k, v or ""))).cast("map<string,string>")[F.col("dir_key")], F.lit("")))
        held = spark.createDataFrame(sorted(files) or [], "key string, name string, is_dir boolean")
        paths = held.select(F.concat_ws("/", "key", "name").alias("path")).unionByName(spark.createDataFrame([("inbox/x.sync-conflict-1",)], "path string"))
        touched.append(recheck.update(spark, root, rows, held, paths).count())
        whole = sorted(map(tuple, check.check_all(rows, held, paths).select("key", F.col("ord").cast("int"), "rule", "severity", "msg").collect()))
        assert sorted(map(tuple, recheck.stored_problems(spark, root).collect())) == whole and whole
        if turn == 0:
            changed = set(rng.sample(keys, 4))
            state.update({k: "wait" for k in changed})
            for k in rng.sample(keys, 3):
                state.pop(k, None)
                changed.add(k)
            for k in rng.sample(keys, 3):
                files ^= {(k, "extra.pdf", False)}
                changed.add(k)
    assert touched == [len(keys) + 1, len(changed), 0]
