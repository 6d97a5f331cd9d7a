"""Patch files: headerless records of five little-endian floats (qx, qy, vx, vy, vz), one file a patch.

``PatchDataSource`` reads a folder with one partition per run of files; a filter on ``pid`` is pushed
into the planning, so files of other patches are never opened. ``write_patches`` writes such a folder.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "pid long, qx int, qy int, vx double, vy double, vz double"
NAME = re.compile(r"patch_(\d+)\.bin$")
RECORD = 20


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class PatchReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("split_bytes", 32 << 20))
        self.tests = []

    def pushFilters(self, filters):
        kinds = {EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x}
        for f in filters:
            if type(f) in kinds and f.attribute == ("pid",):
                self.tests.append((kinds[type(f)], f.value))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        where, base = _open(self.path)
        out, held, total = [], [], 0
        for x in sorted(where.get_file_info(fs.FileSelector(base, allow_not_found=True)), key=lambda x: x.path):
            m = NAME.search(x.path)
            if m and all(t(int(m[1]), v) for t, v in self.tests):
                if held and total + x.size > self.size:
                    out.append(Files(held))
                    held, total = [], 0
                held.append(x.path)
                total += x.size
        return [*out, Files(held)]

    def read(self, partition):
        import numpy as np
        import pyarrow as pa

        where, _ = _open(self.path)
        for path in partition.paths:
            with where.open_input_file(path) as f:
                raw = f.read()
            a = np.frombuffer(raw[: len(raw) // RECORD * RECORD], "<f4").reshape(-1, 5)
            pid = np.full(len(a), int(NAME.search(path)[1]), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pid), *(pa.array(a[:, i].astype(np.int32)) for i in (0, 1)), *(pa.array(a[:, i].astype(np.float64)) for i in (2, 3, 4))], ["pid", "qx", "qy", "vx", "vy", "vz"]
            )


class PatchDataSource(DataSource):
    """``spark.read.format("patches").load(folder)``"""

    @classmethod
    def name(cls):
        return "patches"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PatchReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PatchDataSource)


def write_patches(points: DataFrame, folder: str) -> DataFrame:
    """One file a patch, in mesh order; returns (pid, points). A patch is bounded by its mesh, so one task holds one patch.

    Files get their name when complete, so a task that runs twice leaves one whole file.
    """

    def run(batches):
        import uuid

        import numpy as np
        import pyarrow as pa

        where, base = _open(folder)
        where.create_dir(base, recursive=True)

        def flush(pid, parts):
            a = np.concatenate(parts)
            temp = f"{base}/.{uuid.uuid4().hex}"
            with where.open_output_stream(temp) as f:
                f.write(a.astype("<f4").tobytes())
            where.move(temp, f"{base}/patch_{pid}.bin")
            return pa.RecordBatch.from_arrays([pa.array([pid], pa.int64()), pa.array([len(a)], pa.int64())], ["pid", "points"])

        at, held = None, []
        for b in batches:
            pids = b.column(0).to_numpy()
            a = np.column_stack([b.column(i).to_numpy().astype(np.float64) for i in range(1, 6)])
            cut = np.flatnonzero(np.diff(pids)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(pids)], strict=True):
                if hi == lo:
                    continue
                if at is not None and pids[lo] != at:
                    yield flush(at, held)
                    held = []
                at = int(pids[lo])
                held.append(a[lo:hi])
        if held:
            yield flush(at, held)

    rows = points.select(F.col("pid").cast("long").alias("pid"), "qx", "qy", "vx", "vy", "vz")
    return rows.repartition("pid").sortWithinPartitions("pid", "qx", "qy").mapInArrow(run, "pid long, points long")
