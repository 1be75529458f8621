"""Newest answers in keyed state, and partials in merging levels: late and repeated rows, restarts, crashes."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voxgauge.streaming import incremental as inc
from voxgauge.streaming import keyed, levels

SCHEMA = "k string, ts timestamp, id long, v double"
LATE, KEEP = timedelta(hours=2), timedelta(hours=4)


def at(hour, minute=0):
    return datetime(2024, 3, 1 + hour // 24, hour % 24, minute)


FILES = [
    [("a", at(10), 1, 1.0), ("b", at(9), 2, 2.0), ("a", at(10), 1, 1.0), (None, at(10), 3, None), ("t", None, 9, 9.0)],
    [("a", at(9), 4, 4.0), ("b", at(9), 5, 5.0), ("c", at(11), 6, 6.0), ("c", at(11), 7, None)],  # a: older than what is held
    [("d", at(20), 8, 8.0), ("a", at(8, 59), 10, 0.0)],  # a: late; the watermark goes to 18
    [("c", at(11), 6, 6.0), ("e", at(17, 59), 11, 1.0), ("b", at(19), 12, 2.0)],  # c, e: late; b comes back, its state is too old
    [("b", at(21), 13, 3.0), ("d", at(20), 8, 8.0), ("a", at(23), 14, 4.0)],  # d: repeated
    [("a", at(22), 15, 5.0), ("a", at(23), 14, 4.0), ("b", at(21), 12, 0.0)],  # nothing newer
]
WANT = [
    (0, "a", 1, 1.0, True), (0, "b", 2, 2.0, True), (0, None, 3, None, True), (1, "b", 5, 5.0, False), (1, "c", 7, None, True),
    (2, "d", 8, 8.0, True), (3, "b", 12, 2.0, True), (4, "b", 13, 3.0, False), (4, "a", 14, 4.0, True),
]


def write(spark, folder, files):
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, out):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    query = keyed.stream_newest_answers(stream, ["k"], ["ts", "id"], ["v"], LATE, KEEP, f"{out}/changes", f"{out}/state")
    query.awaitTermination()
    return query


def changes(spark, out):
    rows = spark.read.parquet(f"{out}/changes").collect()
    return sorted(((r["batch"], r["k"], r["id"], r["v"], r["fresh"]) for r in rows), key=repr)


def test_late_repeated_and_out_of_order_rows(spark, tmp_path):
    write(spark, str(tmp_path / "in"), FILES)
    query = run(spark, str(tmp_path / "in"), tmp_path)
    assert changes(spark, tmp_path) == sorted(WANT, key=repr)
    read = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert read == [len(rows) for rows in FILES]  # every batch reads its own file, none of the earlier ones
    last = inc.merged_last_per_key(spark, str(tmp_path / "changes"), ["k"], ["ts", "id"], ["id", "v"])
    assert {(r["k"], r["id"]) for r in last.collect()} == {("a", 14), ("b", 13), ("c", 7), ("d", 8), (None, 3)}


def test_restart_from_the_checkpoint(spark, tmp_path):
    """Stopped after every second file: the state and the watermark come back, batches are numbered on."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for n in range(0, len(FILES), 2):
        write(spark, str(tmp_path / "in"), FILES[n:n + 2])
        run(spark, str(tmp_path / "in"), tmp_path)
    found = [row[1:] for row in sorted(changes(spark, tmp_path), key=lambda r: r[0])]
    assert sorted(found, key=repr) == sorted([w[1:] for w in WANT], key=repr)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_silent_keys_leave_the_state(spark, tmp_path):
    """The number of keys in state follows the keys of the last hours, not those of the whole stream."""
    files = [[(f"k{n}x{i}", at(3 * n), i, 0.0) for i in range(20)] for n in range(8)]
    write(spark, str(tmp_path / "in"), files)
    query = run(spark, str(tmp_path / "in"), tmp_path)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert spark.read.parquet(str(tmp_path / "changes")).count() == 160 and max(kept) <= 3 * 80


def partial(spark, batch):
    return spark.createDataFrame([("all", 1), (f"b{batch % 5}", batch)], "k string, n long").coalesce(1)


def summed(partials):
    return partials.groupBy("k").agg(F.sum("n").alias("n")).coalesce(1)


def state(spark, folder):
    return dict(map(tuple, summed(levels.live_partials(spark, folder)).collect()))


def wanted(batches):
    return {"all": batches} | {f"b{k}": sum(range(k, batches, 5)) for k in range(min(5, batches))}


def test_forty_batches_leave_few_folders(spark, tmp_path):
    folder = str(tmp_path)
    for batch in range(40):
        levels.add_partial(partial(spark, batch), batch, folder, summed, fan=3)
        assert len(levels.live_entries(spark, folder)) <= 2 * 4
    assert state(spark, folder) == wanted(40)
    live = levels.live_entries(spark, folder)
    assert [(e[2], e[3]) for e in live] == [(0, 26), (27, 35), (36, 38), (39, 39)]  # 40 is 1111 by threes
    assert len(os.listdir(f"{folder}/data")) <= 12 and len(os.listdir(f"{folder}/manifest")) == 2


def test_crashes_and_replays_count_nothing_twice(spark, tmp_path, monkeypatch):
    """Stopped after the partial, within the merge, before the snapshot, and replayed after it."""
    folder = str(tmp_path)
    for batch in range(3):
        levels.add_partial(partial(spark, batch), batch, folder, summed, fan=2)
    before = state(spark, folder)

    def broken(partials):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        levels.add_partial(partial(spark, 3), 3, folder, broken, fan=2)
    assert state(spark, folder) == before  # the partial is written, but not named
    merges = []

    def lost_at_the_second(partials):
        merges.append(1)
        if len(merges) == 2:
            raise RuntimeError("lost")
        return summed(partials)

    with pytest.raises(RuntimeError):
        levels.add_partial(partial(spark, 3), 3, folder, lost_at_the_second, fan=2)
    assert state(spark, folder) == before  # one merge is written, but not named
    for _ in range(2):  # the replay, and one more after its snapshot
        levels.add_partial(partial(spark, 3), 3, folder, summed, fan=2)
        assert state(spark, folder) == wanted(4)
        assert [(e[2], e[3]) for e in levels.live_entries(spark, folder)] == [(0, 3)]
    assert len(os.listdir(f"{folder}/data")) <= 4


def test_levels_of_a_stream_that_starts_again(spark, tmp_path):
    for n in range(0, len(FILES), 2):
        write(spark, str(tmp_path / "in"), FILES[n:n + 2])
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        levels.run_levels(stream, lambda b: b.groupBy("k").agg(F.count("*").alias("n")).coalesce(1), summed,
                          str(tmp_path / "parts"), str(tmp_path / "state"), fan=2).awaitTermination()
    found = state(spark, str(tmp_path / "parts"))
    keys = [row[0] for rows in FILES for row in rows]
    assert found == {k: keys.count(k) for k in keys}
    assert len(levels.live_entries(spark, str(tmp_path / "parts"))) <= 3


def test_keys_of_one_bucket_keep_their_own_rows_of_any_type(spark, tmp_path, monkeypatch):
    """All keys in one bucket: held rows go through the state again and again, whatever their types, and expire one by one."""
    import math
    from datetime import date
    from decimal import Decimal

    monkeypatch.setattr(keyed, "BUCKETS", 1)
    schema = "k double, day date, ts timestamp, id long, v struct<at:timestamp,xs:array<decimal(12,3)>,b:binary>"
    value = lambda n: (at(n), [Decimal(n), None], bytes([n]))
    files = [[(0.0, date(2024, 1, 1), at(10), 1, value(1)), (math.nan, None, at(9), 2, value(2)), (2.0, date(2024, 1, 2), at(4), 3, None)],
             [(-0.0, date(2024, 1, 1), at(9), 4, value(4)), (math.nan, None, at(11), 5, value(5))],
             [(-0.0, date(2024, 1, 1), at(10, 30), 6, value(6)), (2.0, date(2024, 1, 2), at(13), 7, value(7))]]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = keyed.stream_newest_answers(stream, ["k", "day"], ["ts", "id"], ["v"], LATE, KEEP, str(tmp_path / "changes"), str(tmp_path / "state"))
    query.awaitTermination()
    found = {(r["batch"], r["id"]): (r["k"], r["day"], r["ts"], r["v"], r["fresh"]) for r in spark.read.parquet(str(tmp_path / "changes")).collect()}
    assert set(found) == {(0, 1), (0, 2), (0, 3), (1, 5), (2, 6), (2, 7)}
    assert {i for (_, i), r in found.items() if r[-1]} == {1, 2, 3, 7}  # 2.0 was forgotten, its newest row was of hour 4
    rows = {r[3]: r for file in files for r in file}
    for (_, i), (k, day, ts, v, _) in found.items():
        assert (day, ts) == rows[i][1:3] and (v and (v["at"], v["xs"], bytes(v["b"]))) == rows[i][4]
        assert k == rows[i][0] or math.isnan(k) and math.isnan(rows[i][0])
    calls = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(calls) <= 3  # one value and one timer, not one per key
