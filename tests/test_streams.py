from datetime import datetime, timedelta

from paperloom.plans import streams
from paperloom.streaming import events as S


def test_files_that_overlap_in_time_lose_no_rows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    for k in (2, 0, 3, 1):  # each file spans the whole period
        rows = [(10 * i + k, start + timedelta(hours=6 * i + k), 1, "view", 1.0, None) for i in range(8)]
        spark.createDataFrame(rows, S.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    late = [(1000, start + timedelta(days=30), 2, "view", 1.0, None)]
    spark.createDataFrame(late, S.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    folder = str(tmp_path)
    windows = streams.stm_windows(spark, folder).collect()
    assert len(windows) == 8 and all(r.events == 4 for r in windows)
    assert [(r.user_id, r.sittings, r.events) for r in streams.stm_sittings(spark, folder).collect()] == [(1, 1, 32)]
    assert [(r.event_type, r.events) for r in streams.stm_first(spark, folder).collect()] == [("view", 33)]
