"""Monitors fed file by file agree with the batch operators."""

import random

import pytest

from cladeframe.operators import fit
from cladeframe.operators import splits as sp
from cladeframe.operators import trace as tr
from cladeframe.operators import trees as tt
from cladeframe.streaming import monitors as mo


def feed(spark, path, data, schema, parts):
    rng = random.Random(0)
    rng.shuffle(data)
    # every part repeats the last point of the part before
    for i in range(parts):
        chunk = data[i::parts] + (data[:1] if i else [])
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(path)


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_trace(spark, tmp_path):
    data = [(r, i, p, float((i * 7 + len(r)) % 5)) for r in ("a", "bb") for i in range(40) for p in ("x", "y")]
    feed(spark, str(tmp_path / "in"), data, mo.TRACE, 4)
    run(mo.stream_trace(mo.read_growing(spark, str(tmp_path / "in"), mo.TRACE, 1)), "trace_out", "complete")
    got = {(r.run, r.param): (r.n, r.mean, r.variance) for r in spark.table("trace_out").collect()}
    batch = tr.trace_moments(spark.createDataFrame(data, mo.TRACE))
    assert got == {(r.run, r.param): (r.n, pytest.approx(r.mean), pytest.approx(r.variance)) for r in batch.collect()}


def test_splits(spark, tmp_path):
    shapes = ["((a:1,b:1):1,(c:1,d:1):1);", "((a:1,c:1):1,(b:1,d:1):1);", "(a:1,b:1,c:1,d:1);"]
    data = [(r, i, shapes[(i * i + len(r)) % 3]) for r in ("one", "three") for i in range(30)]
    feed(spark, str(tmp_path / "in"), data, mo.TREES, 3)
    seen = []
    q = mo.watch_splits(mo.read_growing(spark, str(tmp_path / "in"), mo.TREES, 1), lambda df, epoch: seen.append(df.first().asDict()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    trees = spark.createDataFrame(data, mo.TREES)
    freq = sp.split_freq(tt.tree_splits(trees), sp.tree_counts(trees))
    want = sp.overall_difference(sp.compare_runs_splits(freq)).first().asDict()
    assert len(seen) >= 2 and seen[-1] == pytest.approx(want)


def test_logz_survives_a_restart(spark, tmp_path):
    rng = random.Random(4)
    data = [("r", c, i, rng.gauss(-300 * c, 150)) for c in range(3) for i in range(50)]
    source, check, out = (str(tmp_path / n) for n in ("in", "cp", "out"))
    bands = None
    for half in (data[:75], data[75:] + data[:5]):
        feed(spark, source, list(half), mo.DELTAS, 2)

        def keep(df, epoch):
            df.write.mode("overwrite").parquet(out)

        q = mo.stream_logz(mo.read_growing(spark, source, mo.DELTAS, 1)).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", check).start()
        q.processAllAvailable()
        q.stop()
        bands = spark.read.parquet(out)
    got = {r.cycle: (r.npoint, r.logz, r.ess) for r in mo.logz_snapshot(bands).collect()}
    from pyspark.sql import functions as F

    draws = spark.createDataFrame(data, mo.DELTAS).withColumn("dlogprior", F.lit(0.0))
    want = {r.cycle: (r.npoint, pytest.approx(r.logz), pytest.approx(r.ess)) for r in fit.stepping_estimate(draws).collect()}
    assert got == want


def test_intervals():
    import numpy as np

    from cladeframe.streaming import seen

    rng = random.Random(3)
    none = np.zeros(0, np.int64)
    starts, ends, known = none, none, set()
    for _ in range(60):
        numbers = np.array([rng.randrange(80) for _ in range(rng.randrange(9))], np.int64)
        new = seen.unseen(starts, ends, numbers)
        want = [x not in known and x not in numbers[:i] for i, x in enumerate(numbers)]
        assert new.tolist() == want
        starts, ends = seen.merged(starts, ends, numbers[new])
        known |= set(numbers.tolist())
        held = [x for a, b in zip(starts, ends, strict=True) for x in range(a, b + 1)]
        assert held == sorted(known) and (starts[1:] > ends[:-1] + 1).all()


def test_state_does_not_grow_with_the_points(spark, tmp_path):
    """Files that come late, out of order and twice; the state is one row for each range of numbers."""
    data = [("a", i, "x", float(i % 7)) for i in range(600)]
    source, check = str(tmp_path / "in"), str(tmp_path / "cp")
    rows = []
    for a in (400, 0, 200, 0, 400):
        spark.createDataFrame(data[a : a + 200], mo.TRACE).coalesce(1).write.mode("append").parquet(source)
        q = (
            mo.stream_trace(mo.read_growing(spark, source, mo.TRACE)).writeStream.outputMode("complete").format("memory")
            .queryName("late_out").option("checkpointLocation", check).trigger(availableNow=True).start()
        )
        q.awaitTermination()
        operators = q.lastProgress["stateOperators"]
        rows.append(max(o["numRowsTotal"] for o in operators))
    got = spark.table("late_out").first()
    want = tr.trace_moments(spark.createDataFrame(data, mo.TRACE)).first()
    assert (got.n, got.mean, got.variance) == (want.n, pytest.approx(want.mean), pytest.approx(want.variance))
    assert max(rows) <= 2
