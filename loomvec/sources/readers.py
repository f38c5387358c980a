"""Readers: Parquet, delimited text, JSON lines, JSON reports, audio folders, NumPy files, ZIP members."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomvec.functions.text import parse_bool
from loomvec.operators.manifest import GuardError, require_columns

#: Rows of a matrix in one batch.
ROWS = 1024
#: Columns of a headerless meta file, in order (fixed values).
META = ("path", "original_file", "language", "is_original_language", "duration", "training_data", "model_name", "architecture", "transcript")


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """With ``columns`` only those are read; a missing one raises."""
    df = spark.read.parquet(path)
    return require_columns(df, *columns).select(*columns) if columns else df


def row_count(spark: SparkSession, path: str) -> int:
    """From the footers: no column is read."""
    return spark.read.parquet(path).count()


def meta_csv(spark: SparkSession, pattern: str, require_original: bool = False) -> DataFrame:
    """'|'-separated, headerless, unquoted meta files of a glob; language and generator folder from the path.

    A line that doesn't fit fails the read. ``language`` must equal the folder
    in front of the generator's, else the rows are reported by ``mixed_languages``.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in META])
    df = spark.read.schema(schema).option("sep", "|").option("quote", "").option("mode", "FAILFAST").csv(pattern)
    parts = F.split(F.col("_metadata.file_path"), "/")
    df = df.select("*", F.element_at(parts, -3).alias("lang_folder"), F.element_at(parts, -2).alias("generator_dir"))
    df = df.withColumn("is_original_language", parse_bool(F.col("is_original_language"))).withColumn("duration", F.expr("try_cast(duration as double)"))
    return df.where("is_original_language") if require_original else df


def mixed_languages(meta: DataFrame) -> DataFrame:
    """Rows whose language isn't their folder's."""
    return meta.where(F.lower(F.trim("language")) != F.lower("lang_folder"))


def csv_with_header(spark: SparkSession, path: str, *required: str) -> DataFrame:
    return require_columns(spark.read.option("header", True).option("inferSchema", True).csv(path), *required)


def json_lines(spark: SparkSession, path: str, schema: str, order: list[str] | None = None, keys: Iterable[str] = ()) -> DataFrame:
    """Broken lines are left out; with ``keys`` the last record of each wins."""
    from loomvec.operators.manifest import last_wins

    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return last_wins(df, order, *keys) if order else df


def json_report(spark: SparkSession, path: str) -> dict:
    """A whole JSON document, through Spark so that any store can hold it."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def find_key(report: object, name: str) -> object:
    """First value of a key anywhere in a report, outer before inner; raises if there is none."""
    level = [report]
    while level:
        deeper = []
        for x in level:
            if isinstance(x, dict):
                if name in x:
                    return x[name]
                deeper += x.values()
            elif isinstance(x, list):
                deeper += x
        level = deeper
    raise KeyError(name)


def audio_files(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """path, length and content of the audio files below a folder; ``content`` is read only where it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def from_path(path: Column, position: int) -> Column:
    """A folder's name, counted from the end of the path (-1: the file)."""
    return F.try_element_at(F.split(path, "/"), F.lit(position))


def _contents(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the files of a glob, one file to a task at a time."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def npy(spark: SparkSession, path: str, rows: DataFrame | None = None) -> DataFrame:
    """(path, row, r): rows of the 2-D ``.npy`` files of a glob, read on the executors; with ``rows`` (row) only those."""

    def run(batches):
        for records in batches:
            for name, raw in zip(records.column(0), records.column(1), strict=True):
                matrix = np.load(io.BytesIO(raw.as_py()), allow_pickle=False)
                if matrix.ndim != 2:
                    raise GuardError("not a matrix")
                for start in range(0, len(matrix), ROWS):
                    part = np.ascontiguousarray(matrix[start : start + ROWS], np.float64)
                    ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(part)), pa.array(np.arange(start, start + len(part))), pa.ListArray.from_arrays(ends, pa.array(part.reshape(-1)))], names=["path", "row", "r"])

    found = _contents(spark, path).mapInArrow(run, "path string, row long, r array<double>")
    return found.join(rows.select(F.col("row").cast("long")).distinct(), "row", "left_semi") if rows is not None else found


def block_npz(spark: SparkSession, path: str) -> DataFrame:
    """(generator, block, n, r): the block tensors of ``.npz`` files, read on the executors; blocks without rows are left out."""

    def run(batches):
        for records in batches:
            for raw in records.column(1):
                with np.load(io.BytesIO(raw.as_py()), allow_pickle=False) as z:
                    ids, blocks, vectors, counts = (z[k] for k in ("generator_ids", "block_ids", "block_vectors", "block_counts"))
                i, j = np.nonzero(counts > 0)
                yield pa.RecordBatch.from_arrays([pa.array([str(x) for x in ids[i]]), pa.array(blocks[j].astype(np.int32)), pa.array(counts[i, j].astype(np.int32)), pa.array([x.astype(np.float64) for x in vectors[i, j]], pa.list_(pa.float64()))], names=["generator", "block", "n", "r"])

    return _contents(spark, path).mapInArrow(run, "generator string, block int, n int, r array<double>")


def zip_members(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, member, content): of each archive of a glob, on the executors, the only member whose name ends so."""

    def run(batches):
        for records in batches:
            for name, raw in zip(records.column(0), records.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(raw.as_py())) as z:
                    found = [n for n in z.namelist() if n.endswith(suffix)]
                    if len(found) != 1:
                        raise GuardError(f"{len(found)} members of {name.as_py()} end with {suffix}")
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array(found), pa.array([z.read(found[0])], pa.binary())], names=["path", "member", "content"])

    return _contents(spark, path).mapInArrow(run, "path string, member string, content binary")


def zip_member(spark: SparkSession, path: str, suffix: str) -> bytes:
    """The only member of one archive whose name ends so."""
    return bytes(zip_members(spark, path, suffix).first()["content"])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files of a glob, hashed where they are read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def input_signature(spark: SparkSession, path: str) -> str:
    """Digest of names, sizes and times of the files of a glob, in order; contents aren't read. A resumed run compares it."""
    from loomvec.sources.sinks import config_digest

    listed = spark.read.format("binaryFile").load(path).select("path", "length", F.unix_millis("modificationTime").alias("time"))
    return config_digest([list(r) for r in listed.orderBy("path").collect()])


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists in its store; else an error that lists all."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return path
    raise FileNotFoundError("none exists: " + ", ".join(paths))
