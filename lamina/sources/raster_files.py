"""Patches as raster folders: x.tif, y.tif and z.tif (32-bit floats, -1 at holes) and meta.json with box and scale.

``RasterDataSource`` is written to: ``df.write.format("rasters").mode("append").save(folder)`` with rows (pid, qx, qy, vx, vy, vz), a
patch's rows together. A task writes into a folder of its own; the driver moves the patches of the tasks that
it accepts into place, or clears away what all tasks wrote if the job fails, so a task that is lost or runs twice leaves nothing.
Writing a patch that is there replaces it. Of points on one place the last in row order stays.
"""

from __future__ import annotations

import json
import struct
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lamina.sources.patch_files import _open

SCHEMA = "pid long, qx long, qy long, vx double, vy double, vz double"
HOLE = -1.0


def tiff(rows) -> bytes:
    """An image of one strip of little-endian floats, rows from the top."""
    height, width = rows.shape
    # fixed values: tags of the TIFF format (number, type, value): size, bits, no compression, black is zero, strip, samples, rows a strip, bytes, plain layout, floats
    tags = [(256, 4, width), (257, 4, height), (258, 3, 32), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, height), (279, 4, 4 * width * height), (284, 3, 1), (339, 3, 3)]
    data = rows.astype("<f4").tobytes()
    head = struct.pack("<2sHI", b"II", 42, 8 + len(data))
    return head + data + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", n, t, 1, v) for n, t, v in tags) + struct.pack("<I", 0)


def read_tiff(raw: bytes):
    """The floats of an image as :func:`tiff` writes it."""
    import numpy as np

    at = struct.unpack("<I", raw[4:8])[0]
    count = struct.unpack("<H", raw[at : at + 2])[0]
    tag = {n: v for n, _, _, v in (struct.unpack("<HHII", raw[at + 2 + 12 * i : at + 14 + 12 * i]) for i in range(count))}
    return np.frombuffer(raw, "<f4", tag[256] * tag[257], tag[273]).reshape(tag[257], tag[256])


@dataclass
class Written(WriterCommitMessage):
    folder: str
    patches: list[int] = field(default_factory=list)


class RasterWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.job = uuid.uuid4().hex

    def write(self, iterator):
        import numpy as np
        import pyarrow as pa

        where, base = _open(self.path)
        own = f"{base}/_job-{self.job}/task-{uuid.uuid4().hex}"
        done: list[int] = []

        def put(name: str, data: bytes) -> None:
            with where.open_output_stream(name) as f:
                f.write(data)

        def patch(pid: int, v: np.ndarray) -> None:
            low, high = v[:, :2].min(0).astype(int), v[:, :2].max(0).astype(int)
            at = (v[:, 1].astype(int) - low[1], v[:, 0].astype(int) - low[0])
            folder = f"{own}/patch_{pid}"
            where.create_dir(folder, recursive=True)
            for k, axis in enumerate("xyz"):
                image = np.full((high[1] - low[1] + 1, high[0] - low[0] + 1), HOLE, np.float32)
                image[at] = v[:, 2 + k]
                put(f"{folder}/{axis}.tif", tiff(image))
            box = [v[:, 2:].min(0).tolist(), v[:, 2:].max(0).tolist()]
            # fixed values: the names of format and type that readers of such folders expect
            meta = {"format": "tifxyz", "type": "seg", "uuid": str(uuid.uuid5(uuid.NAMESPACE_URL, f"patch {pid} {box}")), "bbox": box, "scale": [1.0, 1.0], "origin": low.tolist()}
            put(f"{folder}/meta.json", json.dumps(meta).encode())
            done.append(pid)

        held: list[np.ndarray] = []
        now = None
        for batch in iterator:
            t = pa.Table.from_batches([batch])
            pids, v = t.column("pid").to_numpy(), np.column_stack([t.column(c).to_numpy().astype(np.float64) for c in ("qx", "qy", "vx", "vy", "vz")])
            cut = [0, *(np.flatnonzero(np.diff(pids)) + 1).tolist(), len(pids)]
            for lo, hi in zip(cut, cut[1:]):
                if lo == hi:
                    continue
                if now is not None and int(pids[lo]) != now:
                    patch(now, np.concatenate(held))
                    held = []
                now = int(pids[lo])
                held.append(v[lo:hi])
        if held:
            patch(now, np.concatenate(held))
        return Written(own, done)

    def _clear(self) -> None:
        from pyarrow import fs

        where, base = _open(self.path)
        if where.get_file_info(f"{base}/_job-{self.job}").type != fs.FileType.NotFound:
            where.delete_dir(f"{base}/_job-{self.job}")

    def commit(self, messages) -> None:
        from pyarrow import fs

        where, base = _open(self.path)
        for m in messages:
            for pid in m.patches if m is not None else ():
                to = f"{base}/patch_{pid}"
                if where.get_file_info(to).type != fs.FileType.NotFound:
                    where.delete_dir(to)
                where.move(f"{m.folder}/patch_{pid}", to)
        self._clear()

    def abort(self, messages) -> None:
        self._clear()


class RasterDataSource(DataSource):
    @classmethod
    def name(cls):
        return "rasters"

    def schema(self):
        return SCHEMA

    def writer(self, schema, overwrite):
        return RasterWriter(self.options)


def write_rasters(points: DataFrame, folder: str) -> None:
    """One raster folder for each patch; one task holds one patch at a time."""
    points.sparkSession.dataSource.register(RasterDataSource)
    rows = points.select(*(F.col(c).cast(t).alias(c) for c, t in (x.split() for x in SCHEMA.split(", "))))
    rows.repartition("pid").sortWithinPartitions("pid", "qy", "qx", "vx", "vy", "vz").write.format("rasters").mode("append").save(folder)


def read_rasters(spark: SparkSession, folder: str) -> DataFrame:
    """(pid, qx, qy, vx, vy, vz) of all places that are no holes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def run(batches):
        import re

        import numpy as np
        import pyarrow as pa

        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                image = read_tiff(raw.as_py())
                row, col = np.nonzero(image != HOLE)
                m = re.search(r"patch_(-?\d+)/([xyz])\.tif$", path)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), int(m[1]))), pa.array([m[2]] * len(row), pa.string()), pa.array(col), pa.array(row), pa.array(image[row, col].astype(np.float64))], ["pid", "axis", "col", "row", "v"])

    cells = files.mapInArrow(run, "pid long, axis string, col long, row long, v double")
    origin = read_boxes(spark, folder).select("pid", "ox", "oy")
    at = cells.groupBy("pid", "col", "row").agg(*(F.max(F.when(F.col("axis") == a, F.col("v"))).alias(f"v{a}") for a in "xyz"))
    return at.join(origin, "pid").select("pid", (F.col("col") + F.col("ox")).alias("qx"), (F.col("row") + F.col("oy")).alias("qy"), "vx", "vy", "vz")


def read_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """(pid, uuid, ox, oy, x0 ... z1) from the box documents."""
    schema = "uuid string, bbox array<array<double>>, origin array<long>"
    docs = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "meta.json").json(folder)
    pid = F.regexp_extract(F.col("_metadata.file_path"), r"patch_(-?\d+)/meta\.json$", 1).cast("long")
    return docs.select(pid.alias("pid"), "uuid", *(F.col("origin")[i].alias(n) for i, n in enumerate(("ox", "oy"))), *(F.col("bbox")[k][i].alias(f"{a}{k}") for k in (0, 1) for i, a in enumerate("xyz")))
