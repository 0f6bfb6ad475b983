"""Writers: refusal to overwrite, replacement as a whole, manifests that must agree, frozen files."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write(df: DataFrame, path: str, kind: str = "parquet", force: bool = False) -> None:
    """Writes Parquet, JSON lines or CSV; refuses a path that is there unless forced."""
    out = df.write.mode("overwrite" if force else "errorifexists")
    if kind == "csv":
        out.option("header", True).option("escape", '"').csv(path)
    elif kind in ("parquet", "json"):
        getattr(out, kind)(path)
    else:
        raise ValueError(f"unknown kind {kind!r}")


def replace(df: DataFrame, path: str) -> None:
    """Writes beside a path and then takes its place, so a failed run leaves the old data."""
    spark = df.sparkSession
    fresh, old = path.rstrip("/") + ".new", path.rstrip("/") + ".old"
    df.write.mode("overwrite").parquet(fresh)
    fs, target = _fs(spark, path)
    new, kept = _fs(spark, fresh)[1], _fs(spark, old)[1]
    fs.delete(kept, True)
    if fs.exists(target):
        fs.rename(target, kept)
    if not fs.rename(new, target):
        fs.rename(kept, target)
        raise OSError(f"couldn't put {path} in place")
    fs.delete(kept, True)


def read_text(spark: SparkSession, path: str) -> bytes | None:
    """A small file through Spark's file systems; None if it isn't there."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    return bytes(rows[0]["content"])


def run_manifest(spark: SparkSession, path: str, identity: dict, session: dict) -> dict:
    """Writes or extends a run's manifest; a resumed run must have the same identity."""
    held = read_text(spark, path)
    if held is not None:
        manifest = json.loads(held)
        wrong = {k: (manifest["identity"].get(k), v) for k, v in identity.items() if manifest["identity"].get(k) != v}
        if wrong:
            raise RuntimeError(f"another run's manifest (recorded, given): {wrong}")
        manifest["sessions"].append(session)
    else:
        manifest = {"identity": identity, "sessions": [session]}
    fs, p = _fs(spark, path)
    stream = fs.create(p, True)
    stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    stream.close()
    return manifest


def assert_frozen(spark: SparkSession, digests: dict[str, str]) -> None:
    """Files must have the digests that they were frozen with."""
    for path, wanted in digests.items():
        held = read_text(spark, path)
        if held is None or hashlib.sha256(held).hexdigest() != wanted:
            raise RuntimeError(f"{path} isn't the frozen file")
