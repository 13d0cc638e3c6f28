"""Group release, resume and chains on streams of files."""

import datetime
import hashlib

from pyspark.sql import functions as F

from citeloom.streaming import barrier

SCHEMA = "group_id string, citation_id string, group_size int, ts timestamp"


def test_groups_are_released_once_whole_or_late(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    days = [
        [("g1", "a", 2, at(0)), ("g2", "x", 3, at(1))],
        [("g1", "b", 2, at(2)), ("g1", "a", 2, at(2)), ("g3", "s", 1, at(3))],
        [("g2", "y", 3, at(4))],
        [("g9", "late", 1, datetime.datetime(2024, 1, 3))],
        [("g8", "later", 1, datetime.datetime(2024, 1, 5))],
    ]
    out, source = [], tmp_path / "in"
    source.mkdir()

    def write(batch, number):
        out.extend((number, r.group_id, list(r.members), r.released) for r in batch.collect())

    for rows in days:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        barrier.resumable(barrier.whole_groups(stream), write, str(tmp_path / "checkpoint")).awaitTermination()
    numbers = [n for n, *_ in out]
    assert numbers == sorted(numbers)
    got = {g: (members, how) for _, g, members, how in out}
    assert len(out) == len(got)
    assert got["g1"] == (["a", "b"], "whole") and got["g3"] == (["s"], "whole")
    assert got["g2"] == (["x", "y"], "timeout")


def test_an_unbroken_chain_is_ok(spark):
    rows = [(i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(20)]
    links, link = [], ""
    for i, sha in rows:
        link = hashlib.sha256((link + sha).encode()).hexdigest()
        links.append((i, link))
    states = barrier.chain_state(spark.createDataFrame(links, "place int, link string"), spark.createDataFrame(rows, "place int, sha256 string"))
    assert [r.state for r in states.select(F.col("state")).distinct().collect()] == ["ok"]
