"""Stores that are written again, and the queue's documents, failures, states and cancellation."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from reportloom.sources import sinks
from reportloom.streaming import pipeline

TABLE = "| ITEM NO | DESCRIPTION | CATEGORY | NET SALES |\n|---|---|---|---|\n| {0} | thing {0} | kind | {1} |"


def envelope(*sheets):
    return json.dumps({"result": {"contents": [{"path": "s", "markdown": m, "kind": "worksheet", "rowCount": 1} for m in sheets]}})


def rows(spark, path, *columns):
    return sorted(tuple(r) for r in sinks.read(spark, path).select(*columns).collect())


def test_documents_replace_their_own_rows_alone(spark, tmp_path):
    path = str(tmp_path / "sales")
    frame = lambda *r: spark.createDataFrame(list(r), "doc_id string, manufacturer string, net_sales double")
    sinks.write_sales(frame(("d1", "m", 1.0), ("d1", "m", 2.0)), path)
    sinks.write_sales(frame(("d2", "m", 3.0)), path)
    assert rows(spark, path, "doc_id", "net_sales", "schema_version") == [("d1", 1.0, "v1"), ("d1", 2.0, "v1"), ("d2", 3.0, "v1")]
    sinks.write_sales(frame(("d1", "m", 9.0)), path)
    sinks.write_sales(frame(("d1", "m", 9.0)), path)
    assert rows(spark, path, "doc_id", "net_sales") == [("d1", 9.0), ("d2", 3.0)]
    sinks.write_sales(frame(), path, spark.createDataFrame([("d1",)], "doc_id string"))  # analysed again, nothing found
    assert rows(spark, path, "doc_id", "net_sales") == [("d2", 3.0)]


def test_a_column_that_is_new(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_documents(spark.createDataFrame([("a", 1)], "doc_id string, x int"), path)
    sinks.replace_documents(spark.createDataFrame([("b", 2, "z")], "doc_id string, x int, y string"), path)
    assert rows(spark, path, "doc_id", "x", F.coalesce("y", F.lit("-"))) == [("a", 1, "-"), ("b", 2, "z")]


def test_many_documents_and_deletion(spark, tmp_path):
    sinks.replace_documents(spark.range(3000).select(F.col("id").cast("string").alias("doc_id")), str(tmp_path / "t"))
    assert len(list((tmp_path / "t" / "versions").iterdir())) == 1
    sinks.delete_documents(spark.createDataFrame([("7",), ("no such",)], "doc_id string"), str(tmp_path / "t"), str(tmp_path / "not there"))
    assert sinks.read(spark, str(tmp_path / "t")).count() == 2999
    assert sinks.read(spark, str(tmp_path / "t"), number=1).count() == 3000


@pytest.mark.parametrize("step", ["rows", "documents", "draft", "rename"])
def test_a_crash_at_any_step_leaves_a_whole_state(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    frame = lambda *r: spark.createDataFrame(list(r), "doc_id string, x int")
    sinks.replace_documents(frame(("a", 1), ("b", 2)), path)

    class Crash(Exception):
        pass

    def crash(*_, **__):
        raise Crash

    with monkeypatch.context() as m:
        if step == "rows":
            new = frame(("a", 9)).withColumn("x", F.when(F.col("x") == 9, F.raise_error(F.lit("lost"))).otherwise(0).cast("int"))
        else:
            new = frame(("a", 9))
        m.setattr(*{"rows": (sinks, "SCHEMA_VERSION", "v1"), "documents": (sinks, "_commit", crash), "draft": (sinks._Folder, "put", crash), "rename": (sinks._Folder, "take", crash)}[step])
        with pytest.raises(Exception):  # noqa: B017
            sinks.replace_documents(new, path)
    assert rows(spark, path, "doc_id", "x") == [("a", 1), ("b", 2)]
    sinks.replace_documents(frame(("a", 9)), path)
    assert rows(spark, path, "doc_id", "x") == [("a", 9), ("b", 2)]
    sinks.vacuum(spark, path)
    assert rows(spark, path, "doc_id", "x") == [("a", 9), ("b", 2)]
    assert len(list((tmp_path / "t" / "versions").iterdir())) == 2 and len(list((tmp_path / "t" / "snapshots").glob("[0-9]*"))) == 1


def test_writers_that_meet_both_stay(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    frame = lambda *r: spark.createDataFrame(list(r), "doc_id string, x int")
    sinks.replace_documents(frame(("a", 1)), path)
    take, met = sinks._Folder.take, []

    def between(self, old, new):
        if not met:
            met.append(1)
            sinks.replace_documents(frame(("b", 2)), path)
        return take(self, old, new)

    monkeypatch.setattr(sinks._Folder, "take", between)
    assert sinks.replace_documents(frame(("a", 5), ("c", 3)), path) == 3
    assert rows(spark, path, "doc_id", "x") == [("a", 5), ("b", 2), ("c", 3)]
    met.clear()
    assert sinks.compact(spark, path) == 5  # another write came between, and stays on top
    assert rows(spark, path, "doc_id", "x") == [("a", 5), ("b", 2), ("c", 3)]
    assert len(sinks.snapshot(spark, path)[1]) == 2


def test_ids_with_marks_several_sheets_and_reanalysis(spark, tmp_path):
    raw = [("good#1", envelope(TABLE.format("A1", 5), TABLE.format("A2", 6))), ("good", envelope(TABLE.format("B1", 7)))]
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps({"doc_id": i, "raw_json": r}) for i, r in raw))
    pipeline.start(spark, str(source), target, str(tmp_path / "cp")).awaitTermination(120)
    want = [("good", 0, "B1", 7.0), ("good#1", 0, "A1", 5.0), ("good#1", 1, "A2", 6.0)]
    assert rows(spark, f"{target}/sales", "doc_id", "content_no", "part_no", "net_sales") == want
    assert rows(spark, f"{target}/status", "doc_id", "status", "progress_pct") == [("good", "Done", 100.0), ("good#1", "Done", 100.0)]
    twice = lambda frame: pipeline.analyse(frame).withColumn("net_sales", F.col("net_sales") * 2)
    pipeline.reanalyse(spark, target, spark.createDataFrame([("good",)], "doc_id string"), twice)
    assert rows(spark, f"{target}/sales", "doc_id", "content_no", "part_no", "net_sales") == [("good", 0, "B1", 14.0), *want[1:]]
    assert rows(spark, f"{target}/raw", "doc_id", "raw_json") == sorted(raw)
    pipeline.delete(target, spark.createDataFrame([("good#1",)], "doc_id string"))
    for store in ("raw", "sales", "status"):
        assert {i for i, in rows(spark, f"{target}/{store}", "doc_id")} == {"good"}


def test_instructions_travel_with_the_document_and_may_change(spark, tmp_path):
    both = json.dumps({"result": {"contents": [{"path": n, "markdown": f"# {n}\n" + TABLE.format(n, v)} for n, v in (("A", 5), ("B", 7))]}})
    docs = [("x", both, 'Only read the sheet named "A".'), ("y", both, None), ("z", both, 'Only read the sheet named "C".')]
    raw = spark.createDataFrame(docs, "doc_id string, raw_json string, custom_instructions string")
    target = str(tmp_path)
    sinks.write_raw(raw, f"{target}/raw")
    pipeline.process(raw, target)
    figures = lambda: rows(spark, f"{target}/status", "doc_id", "status", "line_count", F.col("total_net_sales").cast("double"))
    assert figures() == [("x", "Done", 1, 5.0), ("y", "Done", 2, 12.0), ("z", "Failed", None, None)]
    assert rows(spark, f"{target}/sales", "doc_id", "part_no") == [("x", "A"), ("y", "A"), ("y", "B")]
    pipeline.reanalyse(spark, target, spark.createDataFrame([("z", 'Only read the sheet named "B".'), ("x", None), ("no such", None)], "doc_id string, custom_instructions string"))
    assert figures() == [("x", "Done", 2, 12.0), ("y", "Done", 2, 12.0), ("z", "Done", 1, 7.0)]
    assert rows(spark, f"{target}/raw", "doc_id", F.coalesce("custom_instructions", F.lit("-"))) == [("x", "-"), ("y", "-"), ("z", 'Only read the sheet named "B".')]


def test_one_bad_document_leaves_the_others_alone(spark, tmp_path):
    def work(frame):
        bad = F.when(F.col("doc_id") == "d3", F.raise_error(F.lit("unreadable sheet"))).otherwise(F.col("doc_id"))
        return frame.select("doc_id", F.coalesce(bad.cast("string"), F.col("doc_id")).alias("part_no"))

    raw = spark.createDataFrame([(f"d{k}", "x") for k in range(7)], "doc_id string, raw_json string")
    pipeline.process(raw, str(tmp_path), work)
    assert {i for i, in rows(spark, f"{tmp_path}/sales", "doc_id")} == {f"d{k}" for k in range(7) if k != 3}
    status = {i: (s, e) for i, s, e in rows(spark, f"{tmp_path}/status", "doc_id", "status", F.coalesce("error_message", F.lit("")))}
    assert all(status[f"d{k}"] == ("Done", "") for k in range(7) if k != 3)
    assert status["d3"][0] == "Failed" and "unreadable sheet" in status["d3"][1]


def test_a_cancelled_document_ends_as_cancelled(spark, tmp_path):
    slow = F.udf(lambda x: time.sleep(30) or x, "string")
    spark.sparkContext.addJobTag(pipeline.tag("slow"))
    stop = threading.Timer(4, pipeline.cancel, (spark, "slow"))
    stop.start()
    try:
        pipeline.process(spark.createDataFrame([("slow", "x")], "doc_id string, raw_json string"), str(tmp_path), lambda f: f.select(slow("doc_id").alias("doc_id")))
    finally:
        stop.join()
        spark.sparkContext.removeJobTag(pipeline.tag("slow"))
    assert rows(spark, f"{tmp_path}/status", "doc_id", "status") == [("slow", "Cancelled")]


@pytest.mark.parametrize(("was", "now", "fine"), [("Queued", "Extracting", True), ("Mapping", "Done", True), ("Done", "Mapping", False), ("Failed", "Queued", True), ("Queued", "Queued", True)])
def test_states(was, now, fine):
    assert pipeline.allowed(was, now) is fine


def test_states_are_passed_in_order(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "1.json").write_text(json.dumps({"doc_id": "d", "raw_json": envelope(TABLE.format("A", 5))}))
    pipeline.start(spark, str(source), target, str(tmp_path / "cp")).awaitTermination(120)
    status = f"{target}/status"
    seen = [sinks.read(spark, status, number=k + 1).first() for k in range(sinks.snapshot(spark, status)[0])]
    assert [(r.status, r.progress_pct) for r in seen] == [("Queued", 0.0), ("Extracting", 10.0), ("Mapping", 60.0), ("Done", 100.0)]
    ids = spark.createDataFrame([("d",), ("new",)], "doc_id string")
    pipeline.advance(target, ids, "Mapping")  # from Done only to Queued, and a new one first of all there
    assert rows(spark, status, "doc_id", "status") == [("d", "Done")]
    pipeline.advance(target, ids, "Queued")
    assert rows(spark, status, "doc_id", "status") == [("d", "Queued"), ("new", "Queued")]
