"""Step files, {step}.jsonl of a folder, as a Spark data source: a partition a file, and a two-phase writer.

Reading lists names on the driver and streams each file in a task; filters on step leave files
out. Writing stages each task's files beside the folder's own; the commit moves them into
place, so a failed or repeated task leaves nothing, and readers never see half a step. A
step's rows go through one task, one batch at a time. Paths are those that pyarrow's file
systems know.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, SCHEMA = "step_files", "step bigint, line bigint, value string"
#: Bytes that are read at once.
CHUNK_BYTES = 4 << 20
_NAME = re.compile(r"(\d+)\.jsonl")
_STAGE = "_staged-"
_TESTS = {EqualTo: lambda a, b: a == b, EqualNullSafe: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


def step_of(name: str) -> int | None:
    """The step that a file's name says; null for other names."""
    m = _NAME.fullmatch(name)
    return int(m[1]) if m else None


@dataclass
class StepFile(InputPartition):
    path: str
    step: int


class StepReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.tests = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("step",) and f.value is not None:
                self.tests.append((type(f), f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(root))
        found = [StepFile(f.path, step) for f in files if f.is_file and (step := step_of(f.base_name)) is not None]
        return sorted((f for f in found if all(_TESTS[kind](f.step, value) for kind, value in self.tests)), key=lambda f: f.step)

    def read(self, partition: StepFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark reads one empty partition where no file is left
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        line, rest = 0, b""
        with store.open_input_stream(partition.path) as source:
            while True:
                data = source.read(CHUNK_BYTES)
                whole, _, rest = (rest + data).rpartition(b"\n") if data else (rest, b"", b"")
                if whole or data and _:
                    lines = whole.split(b"\n")
                    texts = [x.removesuffix(b"\r").decode(errors="replace") for x in lines]
                    yield pa.RecordBatch.from_pydict({"step": pa.array([partition.step] * len(texts), pa.int64()), "line": pa.array(range(line + 1, line + len(texts) + 1), pa.int64()), "value": pa.array(texts, pa.string())})
                    line += len(texts)
                if not data:
                    return


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[int, str]]


class StepWriter(DataSourceArrowWriter):
    """Writes (step, value) rows, which come sorted by step, to a stage, and moves whole files on commit."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, f"{_STAGE}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, root = fs.FileSystem.from_uri(self.path)
        stage = f"{root.rstrip('/')}/{self.job}/{uuid.uuid4().hex}"  # a task that is run again has a place of its own
        files: list[tuple[int, str]] = []
        out = None
        try:
            for batch in iterator:
                steps, values = batch.column("step"), batch.column("value")
                if steps.null_count or values.null_count:
                    raise ValueError("a row without a step or a value")
                numbers = np.asarray(steps)
                starts = np.flatnonzero(np.diff(numbers, prepend=numbers[:1] - 1))
                for start, end in zip(starts, [*starts[1:], len(numbers)], strict=True):
                    step = int(numbers[start])
                    if not files or files[-1][0] != step:
                        if any(step == s for s, _ in files):
                            raise ValueError(f"the rows of step {step} don't stand together")
                        if out is not None:
                            out.close()
                        store.create_dir(stage, recursive=True)
                        files.append((step, f"{stage}/{step}.jsonl"))
                        out = store.open_output_stream(files[-1][1])
                    out.write("".join(f"{v}\n" for v in values.slice(start, end - start).to_pylist()).encode())
        finally:
            if out is not None:
                out.close()
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        root = root.rstrip("/")
        files = [f for m in messages if m for f in m.files]
        if len({step for step, _ in files}) < len(files):
            self.abort(messages)
            raise ValueError("a step's rows went through several tasks")
        store.create_dir(root, recursive=True)
        if self.overwrite:
            new = {step for step, _ in files}
            for f in store.get_file_info(fs.FileSelector(root)):
                if f.is_file and step_of(f.base_name) not in (None, *new):
                    store.delete_file(f.path)
        for step, path in files:
            store.move(path, f"{root}/{step}.jsonl")
        self._clear(store, root)

    def abort(self, messages: list[Staged | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        self._clear(store, root.rstrip("/"))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.job}")


class StepFiles(DataSource):
    """spark.read.format("step_files").load(folder or file): step, line (from 1), value (the line's text)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> StepReader:
        return StepReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> StepWriter:
        return StepWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters on step reach the reader."""
    spark.dataSource.register(StepFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_step_lines(spark: SparkSession, path: str) -> DataFrame:
    """step, line, value of all step files of a folder, or of one. Other files aren't read; blank lines are lines."""
    register(spark)
    return spark.read.format(FORMAT).load(path)


def read_step_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """step, line and the schema's fields of all records; blank lines are skipped, anything else but an object is an error when run."""
    lines = read_step_lines(spark, path).where(F.btrim("value", F.lit(" \t\r\n")) != "")
    object_ = F.when(F.ltrim("value").startswith("{"), F.from_json("value", schema, {"mode": "FAILFAST"})).otherwise(F.raise_error(F.concat(F.lit("not an object: step "), F.col("step").cast("string"), F.lit(", line "), F.col("line").cast("string"))))
    return lines.select("step", "line", object_.alias("_r")).select("step", "line", "_r.*")


def write_step_lines(lines: DataFrame, folder: str, order: list[str | Column], overwrite: bool = False) -> None:
    """Writes lines (step, value and what orders them) as {step}.jsonl. A step that is there already is replaced; overwrite: other steps go."""
    register(lines.sparkSession)
    dealt = lines.repartition("step").sortWithinPartitions("step", *order).select("step", F.lit(None).cast("long").alias("line"), "value")
    dealt.write.format(FORMAT).mode("overwrite" if overwrite else "append").save(folder)


def write_steps(df: DataFrame, folder: str, step: str = "step", order: list[str] = (), overwrite: bool = False) -> None:
    """Writes rows as the JSON lines of their steps' files, with all their columns, in the given order."""
    names = [c for c in df.columns if c != step]
    value = F.to_json(F.struct(*(F.col(f"`{c}`") for c in names), F.col(f"`{step}`").alias("step")))
    write_step_lines(df.select(F.col(f"`{step}`").cast("long").alias("step"), value.alias("value"), *(F.col(f"`{c}`").alias(f"_o{k}") for k, c in enumerate(order))), folder, [f"_o{k}" for k in range(len(order))], overwrite)
