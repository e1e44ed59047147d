"""The shared folder."""

import time

from lineara import session


def test_sweep_removes_only_old_folders_of_queries(spark):
    root = session.shared_dir(spark)
    for name in ("stream-old", "other-old"):
        spark.range(1).write.mode("overwrite").parquet(f"{root}/{name}")
    assert "stream-old" not in session.sweep(spark, 1.0)
    time.sleep(0.1)
    gone = session.sweep(spark, 0.0)
    assert "stream-old" in gone and "other-old" not in gone
