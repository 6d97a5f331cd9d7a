"""Positional text tables: points, extents, relations, placements and tagged logs; malformed lines are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RELATION = ["p1", "p2", *(f"v{i}" for i in range(6)), *"abcdef"]


def fields(lines: DataFrame, names: list[str], pattern: str = r"[,\s]+", exact: bool = True) -> DataFrame:
    """Numbers of each line, split at commas or white space; lines of another number of fields or other text go."""
    parts = F.split(F.trim(F.regexp_replace("value", "\r", "")), pattern)
    out = lines.select(parts.alias("p"), F.size(parts).alias("n")).where(F.col("n") == len(names) if exact else F.col("n") >= len(names))
    out = out.select(*(F.get("p", F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)))
    ok: Column = F.lit(True)
    for n in names:
        ok = ok & F.col(n).isNotNull()
    return out.where(ok)


def points(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z)"""
    return fields(spark.read.text(path), ["x", "y", "z"])


def mesh_points(spark: SparkSession, path: str) -> DataFrame:
    """(qx, qy, vx, vy, vz); commas or white space, other lines skipped."""
    return fields(spark.read.text(path), ["qx", "qy", "vx", "vy", "vz"])


def extents(spark: SparkSession, path: str, margin: int = 0) -> DataFrame:
    """Six whole numbers a line, grown by ``margin`` on each side."""
    names = [f"{a}{k}" for k in ("min", "max") for a in "xyz"]
    df = fields(spark.read.text(path), names)
    return df.select(*((F.col(n).cast("long") + (margin if n.endswith("max") else -margin)).alias(n) for n in names))


def relations(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Fourteen numbers a line; both ends at most ``most``."""
    df = fields(spark.read.text(path), RELATION).withColumns({c: F.col(c).cast("long") for c in ("p1", "p2")})
    return df.where((F.col("p1") <= most) & (F.col("p2") <= most)) if most is not None else df


def weighted_edges(spark: SparkSession, path: str) -> DataFrame:
    """(p1, p2, w); a header and malformed lines are skipped."""
    return fields(spark.read.text(path), ["p1", "p2", "w"]).withColumns({c: F.col(c).cast("long") for c in ("p1", "p2")})


def id_lists(spark: SparkSession, *paths: str) -> DataFrame:
    """(id): the distinct ids of one or several lists."""
    return fields(spark.read.text(list(paths)), ["id"]).select(F.col("id").cast("long").alias("id")).distinct()


def placements(spark: SparkSession, path: str) -> DataFrame:
    """(pid, x, y, angle)"""
    return fields(spark.read.text(path), ["pid", "x", "y", "angle"], r"\s+").withColumn("pid", F.col("pid").cast("long"))


def tagged_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Absolute (ABS patch flip iters x y a) and relative (REL patch flip iters other var*6 tx*6) records of a log."""
    lines = spark.read.text(path)
    rest = lambda tag: lines.where(F.col("value").startswith(f"{tag} ")).select(F.substring("value", 5, 1 << 20).alias("value"))
    head = ["patch", "flip", "iters"]
    return fields(rest("ABS"), [*head, "x", "y", "a"], r"\s+"), fields(rest("REL"), [*head, "other", *(f"v{i}" for i in range(6)), *(f"t{i}" for i in range(6))], r"\s+")


def run_files(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Result files of several runs with the file each line came from."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"))
    parts = F.split("value", ",")
    return lines.select("file", *(F.get(parts, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)))


def write_lines(df: DataFrame, path: str, form: str, *columns: str) -> None:
    """Rows as text lines of a printf form, for instance vertices: 'v %f %f %f'."""
    df.select(F.format_string(form, *(F.col(c) for c in columns)).alias("value")).write.text(path)


def write_fields(df: DataFrame, path: str, separator: str = ",", tag: str = "", header: bool = False) -> None:
    """Rows as text lines of their columns in order, after a tag; doubles keep every digit, a null is an empty field (and such a line is left out by the readers)."""
    line = F.concat_ws(separator, *([F.lit(tag)] if tag else []), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns))
    lines = df.select(line.alias("value"))
    if header:
        lines = lines.sparkSession.createDataFrame([(separator.join(df.columns),)], "value string").union(lines)
    lines.write.mode("append").text(path)


def write_runs(df: DataFrame, path: str, run: str) -> None:
    """One folder of text lines for each value of the column ``run``."""
    rest = [c for c in df.columns if c != run]
    df.select(run, F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest)).alias("value")).write.partitionBy(run).text(path)


def write_chunks(points_: DataFrame, path: str, size: int = 64, mode: str = "append") -> None:
    """Points as Parquet in folders of chunks of ``size`` voxels (cx, cy, cz): readers of a box open its chunks only."""
    keyed = points_.withColumns({f"c{a}": F.floor(F.col(f"v{a}") / size).cast("int") for a in "xyz"})
    keyed.repartition("cx", "cy", "cz").write.mode(mode).partitionBy("cx", "cy", "cz").parquet(path)


def rewrite_chunks(points_: DataFrame, path: str, size: int = 64, touched: DataFrame | None = None) -> None:
    """Replace the chunks that ``points_`` touches; other chunks stay.

    ``touched`` has the chunks (cx, cy, cz) that are rewritten: those for which no point is left are deleted.
    """
    keyed = points_.withColumns({f"c{a}": F.floor(F.col(f"v{a}") / size).cast("int") for a in "xyz"})
    keyed.repartition("cx", "cy", "cz").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cx", "cy", "cz").parquet(path)
    if touched is not None:
        spark = points_.sparkSession
        empty = touched.select("cx", "cy", "cz").distinct().join(keyed.select("cx", "cy", "cz").distinct(), ["cx", "cy", "cz"], "left_anti")
        base = spark._jvm.org.apache.hadoop.fs.Path(path)
        where = base.getFileSystem(spark._jsc.hadoopConfiguration())
        for c in empty.toLocalIterator():  # names of folders only
            where.delete(spark._jvm.org.apache.hadoop.fs.Path(base, f"cx={c.cx}/cy={c.cy}/cz={c.cz}"), True)


def list_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(cx, cy, cz) of the chunks that hold points."""
    return spark.read.parquet(path).select("cx", "cy", "cz").distinct()


def read_chunks(spark: SparkSession, path: str, around: DataFrame | None = None) -> DataFrame:
    """A chunked store, or its chunks (cx, cy, cz) of ``around`` and the 26 about each of them."""
    df = spark.read.parquet(path)
    if around is None:
        return df
    from lamina.operators.spatial import around as ring

    near = ring(around.select(*(F.col(f"c{a}").cast("long").alias(f"c{i}") for i, a in enumerate("xyz"))).distinct(), 3).distinct()
    return df.join(near.select(*(F.col(f"c{i}").cast("int").alias(f"c{a}") for i, a in enumerate("xyz"))), ["cx", "cy", "cz"], "left_semi")
