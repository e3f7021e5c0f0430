"""Stores under several writers, runs of several tables, and near copies as classes."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from quarry.operators import search, store


def _frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v int")


def _rows(spark, path):
    return sorted(map(tuple, store.current(spark, path).select("k", "v").collect()))


def test_a_writer_that_was_beaten_adds_its_rows_to_the_winners(spark, tmp_path, monkeypatch):
    path, real, raced = f"file://{tmp_path}/s", store._switch, []
    store.publish_changes(_frame(spark, [(1, 1), (2, 1)]), path, "k")

    def beaten(*args, **kw):
        if not raced:
            raced.append(True)
            store.publish_changes(_frame(spark, [(2, 2), (3, 2)]), path, "k")
        return real(*args, **kw)

    monkeypatch.setattr(store, "_switch", beaten)
    store.publish_changes(_frame(spark, [(4, 3)]), path, "k")
    assert raced and _rows(spark, path) == [(1, 1), (2, 2), (3, 2), (4, 3)] and store.version(spark, path) == 3


def test_a_pointer_has_one_owner(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    assert store._switch(spark, path, ["a"], 1) and not store._switch(spark, path, ["b"], 1)
    assert store._pointer(spark, path)[1] == ["a"]
    assert not [p for p in (tmp_path / "s/pointers").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_writers_at_the_same_time_lose_no_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "COMPACT", 3)
    path, wrong = f"file://{tmp_path}/s", []

    def write(k):
        try:
            for n in range(2):
                store.publish_changes(_frame(spark, [(10 * k + n, k)]), path, "k")
        except Exception as e:  # a thread's failure has to reach the test
            wrong.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not wrong and _rows(spark, path) == [(10 * k + n, k) for k in range(4) for n in range(2)]


def test_read_modify_write_is_asked_again(spark, tmp_path, monkeypatch):
    path, real, seen = f"file://{tmp_path}/s", store._switch, []
    add = lambda rows: _frame(spark, [(1, 1)]) if rows is None else rows.withColumn("v", F.col("v") + 1).select("k", "v")
    store.mutate(spark, path, "k", add)
    known = store.version(spark, path)
    assert _rows(spark, path) == [(1, 1)] and not store.source_changed(spark, path, known)

    def beaten(*args, **kw):
        if not seen:
            seen.append(True)
            store.mutate(spark, path, "k", add)
        return real(*args, **kw)

    monkeypatch.setattr(store, "_switch", beaten)
    store.mutate(spark, path, "k", add)
    assert _rows(spark, path) == [(1, 3)] and store.source_changed(spark, path, known)


def test_a_run_is_there_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/runs"
    tables = {"figures": spark.range(5), "variants": spark.range(3)}
    assert store.runs(spark, path).count() == 0

    def die(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(store, "_create", die)
    with pytest.raises(RuntimeError):
        store.publish_run(spark, path, "r1", tables)
    monkeypatch.undo()
    assert store.runs(spark, path).count() == 0
    with pytest.raises(FileNotFoundError):
        store.run_table(spark, path, "r1", "figures")
    told = store.publish_run(spark, path, "r1", tables, facts={"source": "a.pdf"})
    assert told == store.manifest(spark, path, "r1") and store.run_table(spark, path, "r1", "figures").count() == 5
    store.publish_run(spark, path, "r2", {"figures": spark.range(2)}, failed=True)
    assert sorted(map(tuple, store.runs(spark, path).collect())) == [("r1", False, "figures", 5), ("r1", False, "variants", 3), ("r2", True, "figures", 2)]
    with pytest.raises(FileExistsError):
        store.publish_run(spark, path, "r1", tables)
    with pytest.raises(ValueError):
        store.publish_run(spark, path, "../r3", tables)
    spark.range(9).write.mode("append").parquet(told["tables"]["figures"]["path"])
    with pytest.raises(ValueError):
        store.run_table(spark, path, "r1", "figures")


def test_of_two_writers_of_a_run_one_publishes(spark, tmp_path, monkeypatch):
    path, real, raced = f"file://{tmp_path}/runs", store._create, []

    def beaten(*args):
        if not raced:
            raced.append(True)
            store.publish_run(spark, path, "r", {"t": spark.range(2)})
        return real(*args)

    monkeypatch.setattr(store, "_create", beaten)
    with pytest.raises(FileExistsError):
        store.publish_run(spark, path, "r", {"t": spark.range(7)})
    assert store.run_table(spark, path, "r", "t").count() == 2


def test_copies_are_one_class_and_words_of_many_sets_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(search, "SUB_SETS", 2)
    base = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(base)) for k in range(3000)] + [(5000 + k, " ".join(base[:-1] + [f"x{k}"])) for k in range(12)] + [(9000, "far away"), (9001, None), (9002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes, pairs = search.jaccard_classes(docs, 0.85)
    got = {r["rep"]: (r["copies"], r["links"]) for r in classes.collect()}
    assert got == {0: (3000, 3011)} | {5000 + k: (1, 3011) for k in range(12)} | {9000: (1, 0)}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(0, 5000 + k) for k in range(12)} | {(5000 + j, 5000 + k) for k in range(12) for j in range(k)}
    assert sorted(r[0] for r in search.greedy_kept(docs, 0.85).select("doc_id").collect()) == [0, 9000, 9001, 9002]
