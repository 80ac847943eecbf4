import glob
import re

import pyarrow as pa

from planarium.llm.common import arrow
from planarium.operators.graphs import connected_components


def _private(pid):
    """MB that the process holds, without mapped files."""
    with open(f"/proc/{pid}/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) / 1024


def test_workers_give_back_what_a_step_has_freed(spark):
    def step(batches):
        import builtins
        import os

        for batch in batches:
            many = [bytes(1000) for _ in range(300_000)]
            builtins.pinned = bytes(1000)  # lives on behind all others, so that the heap's end can't move down
            del many
            yield pa.record_batch([pa.array([os.getpid()], pa.int64())], ["pid"])

    pid = arrow(spark.range(1).repartition(1), step, "pid long").collect()[0].pid
    assert _private(pid) < 150


def test_rounds_of_components_write_few_files(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        connected_components(spark.range(1).selectExpr("id as a", "id as b")).count()  # sets the checkpoint folder
        files = lambda: len(glob.glob(spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/rdd-*/part-*"))
        before = files()
        found = {r.node: r.root for r in connected_components(spark.range(60).selectExpr("id as a", "id + 1 as b")).collect()}
        assert found == dict.fromkeys(range(61), 0)
        assert files() - before < 60
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
