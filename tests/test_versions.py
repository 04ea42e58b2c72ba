"""Versioned tables: writes tried again, writers that meet, replacements cut off, drafts."""

import pytest

from parchment.sources import tables, versions


def rows_of(spark, path, **more):
    return sorted(map(tuple, versions.current(spark, path, **more).collect()))


def test_a_write_tried_again_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    one, two = (spark.createDataFrame([(k, "x")], "id long, v string") for k in (1, 2))
    assert rows_of(spark, path, schema="id long, v string") == []
    assert [versions.commit(one, path, tag="a"), versions.commit(two, path, tag="b"), versions.commit(two, path, tag="b"), versions.commit(one, path)] == [1, 2, 2, 3]
    assert rows_of(spark, path) == [(1, "x"), (1, "x"), (2, "x")] and rows_of(spark, path, version=1) == [(1, "x")]


def test_a_replacement_cut_off_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    versions.commit(spark.createDataFrame([(1,), (2,)], "id long"), path)
    table = versions.current(spark, path)

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(versions, "_publish", lost)
        versions.commit(table.where("id = 1"), path, replace=True)
    assert rows_of(spark, path) == [(1,), (2,)]
    versions.commit(table.where("id = 1"), path, replace=True)
    assert rows_of(spark, path) == [(1,)] and rows_of(spark, path, version=1) == [(1,), (2,)]


def test_two_writers(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    row = lambda k: spark.createDataFrame([(k,)], "id long")
    versions.commit(row(1), path)
    publish, met = versions._publish, []

    def later(*args):
        if not met:
            met.append(1)
            versions.commit(row(2), path)
        publish(*args)

    with monkeypatch.context() as m:
        m.setattr(versions, "_publish", later)
        assert versions.commit(row(3), path) == 3
        met.clear()
        with pytest.raises(versions.Conflict):
            versions.commit(row(4), path, replace=True)
    assert rows_of(spark, path) == [(1,), (2,), (2,), (3,)]


def test_a_batch_run_again_is_saved_once(spark, tmp_path):
    source, path, log = (f"file://{tmp_path}/{n}" for n in ("in", "out", "log"))
    schema = "k long, n long"

    def stream():
        return tables.autosaved(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), path, log, "k", "n")

    for part in ([(1, 1), (1, 2), (2, 1)], [(1, 3)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream().awaitTermination()
    assert rows_of(spark, path) == [(1, 2), (1, 3), (2, 1)]
    # as after a driver that saved the last batch and was lost before it said so
    last = max((tmp_path / "log" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    stream().awaitTermination()
    assert rows_of(spark, path) == [(1, 2), (1, 3), (2, 1)]


def test_drafts(spark):
    key = ["doc", "page"]
    frame = lambda rows: spark.createDataFrame(rows, "doc long, page long, state string, body string")
    keys = lambda *k: spark.createDataFrame(list(k), "doc long, page long")
    table = frame([(1, 1, "saved", "old"), (1, 2, "draft", "new"), (1, 2, "saved", "old"), (2, 1, "draft", "new")])
    got = lambda df: sorted(map(tuple, df.collect()))
    draft = spark.createDataFrame([(1, 1, "d"), (1, 2, "d"), (3, 1, "d")], "doc long, page long, body string")
    assert got(versions.drafted(table, draft, key)) == [(1, 1, "draft", "d"), (1, 1, "saved", "old"), (1, 2, "draft", "d"), (1, 2, "saved", "old"), (2, 1, "draft", "new"), (3, 1, "draft", "d")]
    assert got(versions.saved(table, keys((1, 1), (1, 2), (9, 9)), key)) == [(1, 1, "saved", "old"), (1, 2, "saved", "new"), (2, 1, "draft", "new")]
    assert got(versions.discarded(table, keys((1, 1), (1, 2), (1, 2)), key)) == [(1, 1, "saved", "old"), (1, 2, "saved", "old"), (2, 1, "draft", "new")]
    assert got(versions.deleted(table, keys((1, 2)), key)) == [(1, 1, "saved", "old"), (2, 1, "draft", "new")]
    assert got(versions.shown(table, key)) == [(1, 1, "saved", "old"), (1, 2, "draft", "new"), (2, 1, "draft", "new")]
