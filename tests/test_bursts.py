from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from tallyframe.streaming import bursts, imports

SCHEMA = "space_id string, second long, k long"


@pytest.fixture
def live(spark, tmp_path):
    """live(batches, seconds): the bursts that a stream of (space, second) batches fires."""
    def run(*batches, seconds=120, delay="1 hour"):
        path, root = str(tmp_path / "in"), str(tmp_path / "out")
        for n, batch in enumerate(batches):
            spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(batch)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
        timed = stream.withColumn("at", F.timestamp_seconds("second"))
        bursts.start_bursts(timed, root, "at", seconds, delay).awaitTermination()
        return rows(spark.read.parquet(f"{root}/rows").select(
            "space_id", F.unix_timestamp("first_at").alias("a"), F.unix_timestamp("fires_at").alias("b"), "mutations"))
    return run


CLOSE = [("end", 10**6)]


def test_a_gap_of_the_whole_period_starts_anew(spark, live):
    batch = [("a", 1000), ("a", 1119), ("b", 1000), ("b", 1120), ("c", 1000), ("c", 1121), (None, 1000), (None, 1001)]
    want = rows(spark.createDataFrame([("a", 1000, 1239, 2), ("b", 1000, 1120, 1), ("b", 1120, 1240, 1), ("c", 1000, 1120, 1),
                                       ("c", 1121, 1241, 1), (None, 1000, 1121, 2)], "s string, a long, b long, n long"))
    assert live(batch, CLOSE) == want
    stored = spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(batch)], SCHEMA).withColumn("at", F.timestamp_seconds("second"))
    found = imports.mutation_bursts(stored, "at", "k", 120)
    assert rows(found.select("space_id", F.unix_timestamp("first_at").alias("a"), F.unix_timestamp("fires_at").alias("b"), "mutations")) == want


def test_bursts_grow_and_join_over_batches(live):
    # in the second batch a row of the past stands between the two bursts of the first, and in the third one goes on
    got = live([("a", 5000), ("a", 5200), ("a", 5200)], [("a", 5100), ("b", 5050)], [("a", 5319), ("a", 5500)], CLOSE)
    assert got == [("a", 5000, 5439, 5), ("a", 5500, 5620, 1), ("b", 5050, 5170, 1)]


def test_a_burst_fires_before_the_stream_ends_and_stays_fired(live):
    # 9000 moves the watermark past the first burst; what comes for it later is behind the watermark and dropped
    got = live([("a", 1000)], [("b", 9000)], [("b", 9001)], [("a", 1001), ("a", 9002)], CLOSE, delay="10 minutes")
    assert got == [("a", 1000, 1120, 1), ("a", 9002, 9122, 1), ("b", 9000, 9121, 2)]


def test_an_open_burst_does_not_fire(live):
    assert live([("a", 1000), ("a", 5000)], delay="1 minute") == [("a", 1000, 1120, 1)]


def test_joined_pieces_against_a_walk():
    draw = np.random.default_rng(4)
    for _ in range(200):
        n = int(draw.integers(0, 12))
        starts = draw.integers(0, 60, n)
        ends, counts = starts + draw.integers(0, 8, n), draw.integers(1, 4, n)
        walk = []
        for s, e, c in sorted(zip(starts, ends, counts)):
            if walk and s - walk[-1][1] < 5:
                walk[-1] = (walk[-1][0], max(walk[-1][1], e), walk[-1][2] + c)
            else:
                walk.append((s, e, c))
        assert list(zip(*[x.tolist() for x in bursts.joined(starts, ends, counts, 5)])) == [tuple(map(int, w)) for w in walk]


def test_the_session_keeps_its_own_state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    with bursts.rocksdb(spark):
        assert "RocksDB" in spark.conf.get(key)
    assert spark.conf.get(key) == before
