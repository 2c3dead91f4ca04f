"""Versioned tables: writers at once, writers that die, readers of a version, streams."""

import threading

import pytest

from cadenza.sinks.versions import Conflict, Versions


def rows(spark, *entries):
    return spark.createDataFrame(list(entries), "url string, at long, status string")


def read(table, version=None):
    return {r["url"]: (r["status"], r["added"], r["updated"]) for r in table.read(version).collect()}


def test_versions(spark, tmp_path):
    table = Versions(spark, f"file://{tmp_path}/a b/ledger")
    assert table.version() == 0 and table.read() is None and table.history() == []
    assert table.put(rows(spark, ("a", 1, "pending"), ("b", 1, "failed"), ("a", 3, "done"), ("a", 2, "failed"), (None, 1, "done")), "url", ["at"]) == 1
    first = table.read()
    assert table.put(rows(spark, ("b", 0, "standalone"), ("c", 1, None)), "url", ["at"]) == 2
    assert read(table) == {"a": ("done", 1, 1), "b": ("standalone", 1, 2), "c": (None, 2, 2)}
    assert read(table, 1) == {"a": ("done", 1, 1), "b": ("failed", 1, 1)} and first.count() == 2
    assert table.put(rows(spark).withColumnRenamed("status", "status"), "url", ["at"]) == 3 and read(table) == read(table, 2)
    more = spark.createDataFrame([("d", 1, "done", "x")], "url string, at long, status string, note string")
    assert table.put(more, "url", ["at"]) == 4 and {r["url"]: r["note"] for r in table.read().collect()} == {"a": None, "b": None, "c": None, "d": "x"}
    assert table.expire(2, 3600.0) == 0 and table.expire(2, -5.0) == 2 and set(read(table)) == {"a", "b", "c", "d"} and len(read(table, 3)) == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        table.read(1)
    assert table.history() == [1, 2, 3, 4] and not [p for p in (tmp_path / "a b" / "ledger" / "log").iterdir() if not p.name.isdigit()]


def test_two_writers_lose_no_row(spark, tmp_path):
    folder, errors = f"file://{tmp_path}/ledger", []

    def work(who):
        try:
            for k in range(4):
                Versions(spark, folder).put(rows(spark, (f"{who}-{k}", k, "done"), ("both", k, who)), "url", ["at"])
        except BaseException as e:
            errors.append(e)

    threads = [threading.Thread(target=work, args=(w,)) for w in "xyz"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    table = Versions(spark, folder)
    assert not errors and table.history() == list(range(1, 13))
    found = read(table)
    assert set(found) == {"both", *(f"{w}-{k}" for w in "xyz" for k in range(4))} and found["both"][1:] == (1, 12)
    assert sorted(v[1] for u, v in found.items() if u != "both") == list(range(1, 13))
    assert len(list((tmp_path / "ledger" / "data").iterdir())) == 12  # those that came second were deleted


def test_a_second_writer_tries_again_and_gives_up_at_last(spark, tmp_path):
    table, other, calls = Versions(spark, f"file://{tmp_path}/l"), Versions(spark, f"file://{tmp_path}/l"), []

    def change(before, version):
        calls.append(version)
        if len(calls) < 3:
            other.put(rows(spark, (f"o{version}", 1, "done")), "url", ["at"])
        return rows(spark, ("mine", 1, str(version))) if before is None else before.drop("added", "updated").union(rows(spark, ("mine", 1, str(version))))

    assert table.commit(change) == 3 and calls == [1, 2, 3]
    assert {r["url"]: r["status"] for r in table.read().collect()} == {"o1": "done", "o2": "done", "mine": "3"}
    calls.clear()
    with pytest.raises(Conflict):
        table.commit(change, tries=2)


def test_a_dead_commit_leaves_the_version_before(spark, tmp_path, monkeypatch):
    table = Versions(spark, f"file://{tmp_path}/l")
    table.put(rows(spark, ("a", 1, "done")), "url", ["at"])
    with monkeypatch.context() as m:
        m.setattr(Versions, "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            table.put(rows(spark, ("a", 2, "failed")), "url", ["at"])
    assert table.version() == 1 and read(table) == {"a": ("done", 1, 1)}
    assert table.put(rows(spark, ("b", 1, "done")), "url", ["at"]) == 2 and set(read(table)) == {"a", "b"}
    assert table.expire(2, -5.0) == 1 and set(read(table)) == {"a", "b"}


def test_a_stream_puts_each_batch_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    table = Versions(spark, f"file://{tmp_path}/l")
    for k in range(3):
        rows(spark, (f"u{k}", k, "done"), ("same", k, f"s{k}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put = table.sink("links", "url", ["at"])

    def twice(batch, number):
        put(batch, number)
        put(batch, number)

    stream = spark.readStream.schema("url string, at long, status string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = read(table)
    assert table.history() == [1, 2, 3] and set(found) == {"u0", "u1", "u2", "same"} and found["same"][1:] == (1, 3)
    put(rows(spark, ("late", 1, "x")), 2)
    Versions(spark, f"file://{tmp_path}/l").sink("others", "url", ["at"])(rows(spark, ("new", 1, "x")), 0)
    assert table.version() == 4 and "late" not in read(table) and "new" in read(table)
