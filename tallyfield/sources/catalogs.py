"""Catalogues of points: binary record files, text, Parquet; centres of spheres; result text."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Fixed values of the binary format: a header of five integers, one of nine
#: floats, the redshift, then a record for each column; every record stands
#: between two copies of its length in bytes, of four bytes each.
_HEADER_INTS, _HEADER_FLOATS = 5, 9
#: Points that a task reads from a record file.
PART_ROWS = 1_000_000


def _records(raw: bytes) -> Iterator[memoryview]:
    view, at = memoryview(raw), 0
    while at < len(view):
        size = int.from_bytes(view[at : at + 4], "little")
        end = at + 4 + size
        if end + 4 > len(view) or int.from_bytes(view[end : end + 4], "little") != size:
            raise ValueError("a record's lengths don't agree")
        yield view[at + 4 : end]
        at = end + 4


def decode_fastfood(raw: bytes) -> list[np.ndarray]:
    """Columns as doubles; single or double precision shows in the records' length."""
    records = list(_records(raw))
    if len(records) < 3 + 3 or len(records[0]) != 4 * _HEADER_INTS:
        raise ValueError("not a record file of points")
    n = int(np.frombuffer(records[0], "<i4")[1])
    columns = []
    for r in records[3:]:
        if n and len(r) not in (4 * n, 8 * n):
            raise ValueError("a column has another length than the header says")
        columns.append(np.frombuffer(r, "<f4" if len(r) == 4 * n else "<f8").astype(float))
    return columns


def encode_fastfood(columns: list[np.ndarray], double: bool = True) -> bytes:
    n, kind = len(columns[0]), "<f8" if double else "<f4"
    header = np.zeros(_HEADER_INTS, "<i4")
    header[1] = n
    parts = [header.tobytes(), np.zeros(_HEADER_FLOATS, kind).tobytes(), np.zeros(1, kind).tobytes(), *(np.asarray(c).astype(kind).tobytes() for c in columns)]
    return b"".join(len(p).to_bytes(4, "little") + p + len(p).to_bytes(4, "little") for p in parts)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, as in local sessions, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found.rstrip("/") if found else tempfile.mkdtemp(prefix="tallyfield-")


class _Ranges:
    """A file of any of Hadoop's file systems, read at given places."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.size = self.fs.getFileStatus(self.path).getLen()
        self.jvm = jvm

    def read(self, at: int, n: int) -> bytes:
        with_ = self.fs.open(self.path)
        try:
            with_.seek(at)
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(with_, n))
        finally:
            with_.close()


def record_layout(file: _Ranges) -> tuple[int, list[tuple[int, int]]]:
    """Number of points, and (place, width of a value) of each column, from the lengths alone."""
    records, at = [], 0
    while at < file.size:
        size = int.from_bytes(file.read(at, 4), "little") if at + 4 <= file.size else -1
        if size < 0 or at + 8 + size > file.size or int.from_bytes(file.read(at + 4 + size, 4), "little") != size:
            raise ValueError("a record's lengths don't agree")
        records.append((at + 4, size))
        at += size + 8
    if len(records) < 3 + 3 or records[0][1] != 4 * _HEADER_INTS:
        raise ValueError("not a record file of points")
    n = int(np.frombuffer(file.read(records[0][0], records[0][1]), "<i4")[1])
    if any(n and size not in (4 * n, 8 * n) for _, size in records[3:]):
        raise ValueError("a column has another length than the header says")
    return n, [(place, size // n if n else 8) for place, size in records[3:]]


def read_fastfood_catalog(spark: SparkSession, path: str, need_weights: bool | None = None) -> DataFrame:
    """``id, x, y, z, w`` of a record file; the id is the point's place.

    The driver reads the records' lengths; points are read in parts of
    ``PART_ROWS``, each by a task of its own that seeks in every column.
    ``need_weights``: True asks for a fourth column, False leaves it out, None
    takes it if it is there; without it ``w`` is null.  The path is one that every
    executor can open.
    """
    n, columns = record_layout(_Ranges(spark, path))
    if need_weights and len(columns) < 4:
        raise ValueError(f"{path} has no weights")
    used = columns[: 4 if need_weights is not False else 3]
    local = path.removeprefix("file://") if path.startswith("file://") else path
    parts = max(1, -(-n // PART_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column(0).to_pylist():
                lo, hi = part * PART_ROWS, min(n, (part + 1) * PART_ROWS)
                if hi <= lo:
                    continue
                with pa.fs.FileSystem.from_uri(local)[0].open_input_file(pa.fs.FileSystem.from_uri(local)[1]) as f:
                    values = [np.frombuffer(f.read_at((hi - lo) * width, place + lo * width), f"<f{width}").astype(float) for place, width in used]
                for i in range(0, hi - lo, 100_000):
                    cut = [pa.array(v[i : i + 100_000]) for v in values]
                    ids = pa.array(np.arange(lo + i, lo + i + len(cut[0])))
                    yield pa.RecordBatch.from_arrays([ids, *cut, *([pa.nulls(len(ids), pa.float64())] if len(cut) < 4 else [])], names=["id", "x", "y", "z", "w"])

    return spark.range(0, parts, 1, parts).mapInArrow(run, "id long, x double, y double, z double, w double")


def read_ascii_catalog(spark: SparkSession, path: str) -> DataFrame:
    """``id, x, y, z, w`` of text with columns between spaces, tabs or commas.

    ``w`` is null without a fourth column.  Blank lines, comments and lines that
    don't parse are left out.  Compressed files are read as Spark reads them.
    """
    parts = F.split(F.trim(F.regexp_replace("value", "[\\s,]+", " ")), " ")
    lines = spark.read.text(path).where(~F.trim("value").startswith("#")).select(parts.alias("p"))
    columns = [F.try_element_at("p", F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate("xyzw")]
    rows = lines.select(*columns).where("x is not null and y is not null and z is not null")
    return rows.select(F.monotonically_increasing_id().alias("id"), "x", "y", "z", "w")


def read_catalog(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """By ``format`` (``f`` records, ``a`` or ``c`` text, ``parquet``) or by the ending; a path without one is tried with ``.ff, .txt, .dat, .csv``."""
    if format is None and not os.path.splitext(path)[1] and os.path.isdir(os.path.dirname(path) or "."):
        path = next((path + e for e in (".ff", ".txt", ".dat", ".csv") if os.path.exists(path + e)), path)
    kind = format or {".ff": "f", ".parquet": "parquet"}.get(os.path.splitext(path)[1], "a")
    if kind == "f":
        return read_fastfood_catalog(spark, path)
    if kind in ("a", "c"):
        return read_ascii_catalog(spark, path)
    if kind == "parquet":
        df = spark.read.parquet(path)
        number = F.col("id") if "id" in df.columns else F.monotonically_increasing_id()
        return df.select(number.cast("long").alias("id"), "x", "y", "z", *(["w"] if "w" in df.columns else [F.lit(None).cast("double").alias("w")]))
    raise ValueError(f"format {format!r} is none of f, a, c, parquet")


def write_ascii_catalog(points: DataFrame, path: str) -> None:
    """A folder of text files, ``x y z w`` a line, written by all tasks."""
    points.select(F.concat_ws(" ", "x", "y", "z", "w")).write.mode("overwrite").text(path)


def write_fastfood_catalog(points: DataFrame, path: str, weights: bool = True, double: bool = True) -> None:
    """One local record file of ``x, y, z[, w]`` in order of ``id``.

    The format has no parts and stores column by column, so the driver writes it;
    points arrive partition by partition and go to their places in each column, so
    it holds one partition at a time.
    """
    columns = ["x", "y", "z"] + (["w"] if weights else [])
    n, kind, width = points.count(), "<f8" if double else "<f4", 8 if double else 4
    if n * width >= 1 << 31:
        raise ValueError("a record holds less than 2 GB")
    header = np.zeros(_HEADER_INTS, "<i4")
    header[1] = n
    mark = lambda size: size.to_bytes(4, "little")
    with open(path, "wb") as f:
        for record in (header.tobytes(), np.zeros(_HEADER_FLOATS, kind).tobytes(), np.zeros(1, kind).tobytes()):
            f.write(mark(len(record)) + record + mark(len(record)))
        start = f.tell()
        at = [start + i * (n * width + 8) + 4 for i in range(len(columns))]
        for place in at:
            f.seek(place - 4)
            f.write(mark(n * width))
            f.seek(place + n * width)
            f.write(mark(n * width))
        done, held = 0, []

        def flush():
            nonlocal done, held
            for place, values in zip(at, zip(*held)):
                f.seek(place + done * width)
                f.write(np.array(values, float).astype(kind).tobytes())
            done, held = done + len(held), []

        for row in points.orderBy("id").select(*columns).toLocalIterator(prefetchPartitions=False):
            held.append(tuple(row))
            if len(held) == 100_000:
                flush()
        flush()


def append_weights(path: str, weights: np.ndarray) -> None:
    """Add a weights record to a local record file, or replace the one it has."""
    with open(path, "rb") as f:
        columns = decode_fastfood(raw := f.read())
    if len(weights) != len(columns[0]):
        raise ValueError("there must be a weight for each point")
    double = len(list(_records(raw))[3]) == 8 * len(weights)
    with open(path, "wb") as f:
        f.write(encode_fastfood([*columns[:3], np.asarray(weights)], double))


def read_centers(spark: SparkSession, path: str, rmax: float, nspheres: int) -> DataFrame | None:
    """``cid, x, y, z, r`` from lines of four numbers; None if there is no file, or its spheres are smaller than ``rmax`` or too few."""
    try:
        rows = read_ascii_catalog(spark, path).select(F.col("id").alias("cid"), "x", "y", "z", F.col("w").alias("r")).where("r is not null")
        n, least = rows.agg(F.count("*"), F.min("r")).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return None if n < nspheres or least < rmax else rows


def write_centers(centers: DataFrame, path: str, rmax: float) -> None:
    """Lines of four numbers in one part; there are as many as spheres were asked for."""
    centers.coalesce(1).sortWithinPartitions("cid").select(F.concat_ws(" ", "x", "y", "z", F.lit(float(rmax)))).write.mode("overwrite").text(path)


def write_counts(table: DataFrame, path: str, log_upper: bool = False) -> None:
    """Tab-separated text; with ``log_upper`` the upper edge as its decimal logarithm."""
    upper = next((c for c in table.columns if c in ("rmax", "smax", "thetamax")), None)
    cells = [F.log10(c) if log_upper and c == upper else F.col(c) for c in table.columns]
    text = F.concat_ws("\t", *[F.concat_ws(" ", c.cast("array<string>")) if table.schema[n].dataType.typeName() == "array" else c.cast("string") for c, n in zip(cells, table.columns)])
    table.select(text).coalesce(1).write.mode("overwrite").text(path)
