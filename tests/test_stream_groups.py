"""The streaming ladder keeps many posts in one state group."""

import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from riselens.streaming import ladder as L


def test_posts_of_a_group_share_state_and_equal_the_batch_ladder(spark, monkeypatch):
    monkeypatch.setattr(L, "STATE_GROUPS", 3)
    root = tempfile.mkdtemp(prefix="riselens-groups-", dir=os.environ.get("TMPDIR", "/tmp"))
    rng, rows = np.random.default_rng(7), []
    for post in range(90):
        created = 1e6 + float(rng.integers(0, 36 * 3600))
        for age in np.unique(rng.integers(0, 260, 7)):
            t = created + 60.0 * float(age) + post / 128
            rows.append((f"p{post}", None if post % 9 == 0 else f"c{post % 4}", created, t, None if age % 11 == 0 else float(age), 0.5 if post % 2 else None, None))
    rows.sort(key=lambda r: r[3] + rng.uniform(0, 1500))            # out of order within the watermark delay
    for i, part in enumerate(np.array_split(np.arange(len(rows)), 6)):
        spark.createDataFrame([rows[k] for k in part], L.OBS_SCHEMA).coalesce(1).write.parquet(f"{root}/input/slice={i:04d}")
    src = spark.readStream.schema(L.OBS_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{root}/input")
    q = L.start(L.ladder_stream(src), f"{root}/out", f"{root}/ck")
    q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert max(held) == 3                                            # a state for each group, not for each post
    got, batch = spark.read.parquet(f"{root}/out"), L.ladder_batch(spark.createDataFrame(rows, L.OBS_SCHEMA))
    assert got.exceptAll(batch).count() == 0
    passed = max(r[3] for r in rows) - 30 * 60
    assert batch.where(F.col("snapshot_time") <= passed).exceptAll(got).count() == 0
    assert got.select("post_id").distinct().count() > 80
