"""Step files as a data source: what is written is read, failed tasks leave nothing, filters leave files out."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sparkgrade import sources
from sparkgrade.sources.steps import CHUNK_BYTES, StepReader, StepWriter, step_of


def files(folder):
    return sorted(p.name for p in folder.iterdir())


def test_round_trip(spark, tmp_path):
    folder = tmp_path / "steps"
    rows = spark.createDataFrame([(k, k % 3, f"é\n{k}", [k, None], {"a": k}) for k in range(50)], "id int, step int, t string, l array<int>, m map<string,int>").repartition(6)
    sources.write_steps(rows, str(folder), order=["id"])
    assert files(folder) == ["0.jsonl", "1.jsonl", "2.jsonl"]
    assert [json.loads(x)["id"] for x in (folder / "1.jsonl").read_text().splitlines()] == list(range(1, 50, 3))
    got = sources.read_step_records(spark, str(folder), "id int, t string, l array<int>, m map<string,int>").collect()
    assert sorted((r.step, r.line, r.id, r.t, r.l, r.m) for r in got) == sorted((k % 3, k // 3 + 1, k, f"é\n{k}", [k, None], {"a": k}) for k in range(50))
    assert sources.read_step_records(spark, str(folder / "2.jsonl"), "id int").count() == 16  # one file
    assert sources.read_steps(spark, str(folder)).count() == 50  # the JSON reader reads them too


def test_steps_replace_their_own_or_all(spark, tmp_path):
    folder = tmp_path / "steps"
    rows = spark.range(10).select("id", (F.col("id") % 5).alias("step"))
    sources.write_steps(rows, str(folder))
    sources.write_steps(rows.where("step = 1 AND id > 3"), str(folder))
    read = lambda: sorted((r.step, r.id) for r in sources.read_step_records(spark, str(folder), "id long").collect())
    assert read() == sorted((k % 5, k) for k in range(10) if k != 1)
    (folder / "kept.txt").write_text("x")
    sources.write_steps(rows.where("step = 4"), str(folder), overwrite=True)
    assert files(folder) == ["4.jsonl", "kept.txt"] and read() == [(4, 4), (4, 9)]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    folder = tmp_path / "steps"
    sources.write_steps(spark.range(3).select("id", F.lit(7).alias("step")), str(folder))
    bad = spark.range(100).select("id", F.when(F.col("id") == 99, F.raise_error(F.lit("no row")).cast("int")).otherwise((F.col("id") % 9).cast("int")).alias("step"))
    with pytest.raises(Exception, match="no row"):
        sources.write_steps(bad, str(folder))
    with pytest.raises(Exception, match="without a step"):
        sources.write_steps(spark.range(3).select("id", F.lit(None).cast("int").alias("step")), str(folder))
    assert files(folder) == ["7.jsonl"]
    # Steps that don't stand together, or come from two tasks, aren't committed either.
    split = spark.range(8).repartition(4).select((F.col("id") * 0).alias("step"), F.lit(None).cast("long").alias("line"), F.lit("{}").alias("value"))
    with pytest.raises(Exception, match="several tasks"):
        split.write.format("step_files").mode("append").save(str(folder))
    mixed = spark.range(8).coalesce(1).select((F.col("id") % 2).alias("step"), F.lit(None).cast("long").alias("line"), F.lit("{}").alias("value"))
    with pytest.raises(Exception, match="stand together"):
        mixed.write.format("step_files").mode("append").save(str(folder))
    assert files(folder) == ["7.jsonl"]


def test_a_repeated_attempt_is_written_once(tmp_path):
    import pyarrow as pa

    writer = StepWriter(str(tmp_path), False)
    batch = pa.RecordBatch.from_pydict({"step": pa.array([3, 3, 4]), "value": ["a", "b", "c"]})
    writer.write(iter([batch]))  # an attempt that was lost after its last row
    writer.commit([writer.write(iter([batch.slice(0, 1), batch.slice(1)])), None])
    assert files(tmp_path) == ["3.jsonl", "4.jsonl"] and (tmp_path / "3.jsonl").read_text() == "a\nb\n"


def test_filters_leave_files_out(spark, tmp_path):
    for k in (1, 2, 30):
        (tmp_path / f"{k}.jsonl").write_text('{"v": 1}\n')
    os.chmod(tmp_path / "2.jsonl", 0)
    (tmp_path / "2.jsonl").unlink()
    (tmp_path / "2.jsonl").symlink_to(tmp_path / "nowhere")  # reading it fails
    lines = sources.read_step_lines(spark, str(tmp_path))
    assert lines.where("step > 2").count() == 1 and lines.where("step IN (1, 30)").count() == 2 and lines.where("step = 5").count() == 0
    reader = StepReader(str(tmp_path))
    assert [step_of(x) for x in ("7.jsonl", "x7.jsonl", "7.json", "007.jsonl", ".7.jsonl.crc")] == [7, None, None, 7, None]
    assert len(reader.partitions()) >= 2


def test_odd_files(spark, tmp_path):
    (tmp_path / "0.jsonl").write_bytes(b"")
    (tmp_path / "1.jsonl").write_bytes(b'\n{"v": 1}\r\n  \n{"v": 2}')  # blank lines; no end of the last one
    (tmp_path / "2.jsonl").write_bytes(b'{"v": "' + b"x" * (CHUNK_BYTES + 10) + b'"}\n{"v": "y"}\n')
    (tmp_path / "sub").mkdir()
    got = sorted((r.step, r.line, r.v if len(r.v) < 9 else len(r.v)) for r in sources.read_step_records(spark, str(tmp_path), "v string").collect())
    assert got == [(1, 2, "1"), (1, 4, "2"), (2, 1, CHUNK_BYTES + 10), (2, 2, "y")]
    (tmp_path / "3.jsonl").write_text("[1]\n")
    with pytest.raises(Exception, match="not an object: step 3, line 1"):
        sources.read_step_records(spark, str(tmp_path), "v string").collect()
    (tmp_path / "3.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        sources.read_step_records(spark, str(tmp_path), "v string").collect()
    with pytest.raises(Exception, match="nowhere"):
        sources.read_step_lines(spark, str(tmp_path / "nowhere")).collect()
    empty = tmp_path / "empty"
    empty.mkdir()
    assert sources.read_step_lines(spark, str(empty)).count() == 0
    sources.write_steps(spark.createDataFrame([], "id int, step int"), str(empty))
    assert files(empty) == []
