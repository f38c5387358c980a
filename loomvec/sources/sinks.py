"""Writers: committed as a whole by Spark's protocol, so a reader never sees a part."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import zipfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomvec.operators.manifest import GuardError


def write_parquet(df: DataFrame, path: str, codec: str = "zstd", max_rows: int = 0) -> None:
    df.write.mode("overwrite").option("compression", codec).option("maxRecordsPerFile", max_rows).parquet(path)


def write_split(df: DataFrame, outputs: dict[str, Column]) -> None:
    """One table to several places, each with its predicate; the table is computed once."""
    from loomvec.session import materialize

    kept = materialize(df, "split")
    for path, wanted in outputs.items():
        write_parquet(kept.where(wanted), path)


def write_locked(df: DataFrame, path: str, schema: T.StructType, max_rows: int = 0) -> None:
    """Written in the schema's order and types: a missing or further column raises, a value that doesn't fit fails the write."""
    if sorted(df.columns) != sorted(schema.fieldNames()):
        raise GuardError(f"columns are {sorted(df.columns)}; the schema has {sorted(schema.fieldNames())}")
    write_parquet(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]), path, max_rows=max_rows)


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    """A whole file in any store: written beside and renamed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place, part = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.part"))
    store = place.getFileSystem(conf)
    out = store.create(part, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    if store.exists(place):
        store.delete(place, False)
    store.rename(part, place)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder with one file and a header, for small tables."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_csv_file(df: DataFrame, path: str, bom: bool = False, most: int = 100_000) -> None:
    """One file, appearing as a whole, with a byte order mark if asked for; a table of more than ``most`` rows is refused."""
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise GuardError(f"more than {most} rows")
    out = io.StringIO()
    lines = csv.writer(out, lineterminator="\n")
    lines.writerow(df.columns)
    lines.writerows(zip(*[c.to_pylist() for c in rows.columns], strict=True))
    _put(df.sparkSession, path, out.getvalue().encode("utf-8-sig" if bom else "utf-8"))


def write_arrays(spark: SparkSession, path: str, **arrays: np.ndarray) -> None:
    """A ``.npz`` of driver-sized arrays (nulls, block tensors), or a ``.npy`` of one, in any store."""
    out = io.BytesIO()
    if path.endswith(".npy"):
        np.save(out, *arrays.values(), allow_pickle=False)
    else:
        np.savez(out, **arrays)
    _put(spark, path, out.getvalue())


def block_arrays(blocks: DataFrame) -> dict[str, np.ndarray]:
    """generator_ids, block_ids, block_vectors and block_counts of a block table (generator, block, n, r): a row for each block, whatever the recordings."""
    rows = blocks.orderBy("generator", "block").collect()
    ids, numbers = sorted({r["generator"] for r in rows}), sorted({r["block"] for r in rows})
    bins = len(rows[0]["r"]) if rows else 0
    vectors, counts = np.full((len(ids), len(numbers), bins), np.nan), np.zeros((len(ids), len(numbers)), np.int64)
    for r in rows:
        at = ids.index(r["generator"]), numbers.index(r["block"])
        vectors[at], counts[at] = r["r"], r["n"]
    return {"generator_ids": np.array(ids, str), "block_ids": np.array(numbers), "block_vectors": vectors, "block_counts": counts}


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def report(df: DataFrame, path: str) -> None:
    """A one-row table as a JSON document, nested fields kept."""
    df.limit(1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def bundle(spark: SparkSession, path: str, *files: str) -> list[str]:
    """A ZIP of those of the (small) files that exist, from any store into any store."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    places = [jvm.org.apache.hadoop.fs.Path(f) for f in files]
    kept = [f for f, p in zip(files, places, strict=True) if p.getFileSystem(conf).exists(p)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in kept:
            z.writestr(os.path.basename(f), bytes(spark.read.format("binaryFile").load(f).first()["content"]))
    _put(spark, path, out.getvalue())
    return kept


def tick(value: float, digits: int = 3) -> str:
    """A number as labels show it: fixed digits, no trailing zeros, a true minus sign, never -0."""
    text = f"{value:.{digits}f}".rstrip("0").rstrip(".") if digits else f"{value:.0f}"
    return text.replace("-", "\u2212") if float(text or 0) else "0"


def config_digest(config: object) -> str:
    """SHA-256 of canonical JSON, the lock that a resumed run is checked against."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()
