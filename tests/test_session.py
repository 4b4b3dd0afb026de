"""Tables written to cut lineage."""

import os

from riselens.session import checkpoint, drop_checkpoint


def test_dropped_tables_leave_others_alone(spark):
    one = checkpoint(spark.range(5))
    two = checkpoint(one.selectExpr("id * 2 AS d"))
    drop_checkpoint(one)
    assert not os.path.exists(one._checkpoint_path)
    assert sorted(r.d for r in two.collect()) == [0, 2, 4, 6, 8]
