from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.operators import snapshots, store


def test_create_restore_and_clean(spark, tmp_path):
    kept = store.VersionedStore(spark, f"file://{tmp_path}/k")
    kept.write(spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z"), (4, None, "n")], "id int, space_id string, text string"))
    shots = snapshots.Snapshots(spark, f"file://{tmp_path}/s")
    first = shots.create(kept.read(), "a", datetime(2024, 1, 1))
    kept.write(spark.createDataFrame([(1, "a", "changed"), (5, "a", "new"), (3, "b", "z2"), (4, None, "n")], "id int, space_id string, text string"))
    shots.restore(first, kept)
    assert sorted((r.id, r.text) for r in kept.read().collect()) == [(1, "x"), (2, "y"), (3, "z2"), (4, "n")]
    assert kept.read(2).count() == 4 and [r.chunks for r in shots.list("a").collect()] == [2] and shots.list("b").count() == 0
    for day in range(2, 6):
        shots.create(kept.read(), "b", datetime(2024, 3, day), "automatic")
    manual = shots.create(kept.read(), "b", datetime(2024, 3, 6))
    assert shots.clean(F.lit("2024-03-07").cast("timestamp"), 30, 7) == 1
    assert shots.clean(F.lit("2024-03-07").cast("timestamp"), 30, 4) == 4
    assert [r.snapshot for r in shots.list().collect()] == [manual] and shots.read(manual).count() == 1
    with pytest.raises(KeyError):
        shots.read(first)
    with pytest.raises(ValueError):
        shots.create(kept.read(), "b", datetime(2024, 1, 1), "other")
