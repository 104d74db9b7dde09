"""Writers: lineage-cutting stages, guarded and sharded outputs."""

from __future__ import annotations

import json
import math
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, which driver and executors share.

    Where it is unset a local session (tests) gets a folder of its own; on a cluster that is an error,
    since other executors could not read a machine's own folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _own.get(spark.sparkContext.applicationId) or "file://" + tempfile.mkdtemp(prefix="wayfold-")
        _own[spark.sparkContext.applicationId] = folder
    return folder


class Stage:
    """Tables that cut lineage, under one folder of the shared one; Hadoop removes it at exit."""

    def __init__(self, spark: SparkSession, name: str = "stage"):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        fs, path = self._fs(self.path)
        fs.deleteOnExit(path)

    def _fs(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        fs, path = self._fs(f"{self.path}/{name}")
        fs.delete(path, True)


def write_records(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines; an existing output is refused unless overwritten."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_shards(df: DataFrame, path: str, n: int, index: str = "sample_index", overwrite: bool = False) -> dict:
    """JSON lines in one folder for each shard, rows dealt round robin by their index; the manifest, also written beside them.

    No rows, more shards than rows, and no shards are errors; counts come from the written files.
    """
    from ..operators.ranking import shards

    if n <= 0:
        raise ValueError("the number of shards must be positive")
    shards(df, n, index).repartition(n, "shard").write.mode("overwrite" if overwrite else "errorifexists").partitionBy("shard").json(path)
    spark = df.sparkSession
    counts = {r["shard"]: r["count"] for r in spark.read.schema("shard int").json(path).groupBy("shard").count().collect()} if exists(spark, path) else {}
    samples = sum(counts.values())
    if not samples or n > samples:
        remove(spark, path)
        raise ValueError("there are no rows" if not samples else f"{n} shards are more than the {samples} rows")
    manifest = {"samples": samples, "num_shards": n, "shard_samples": [counts.get(i, 0) for i in range(n)], "shard_files": [f"{path}/shard={i}" for i in range(n)]}
    write_text(spark, f"{path}_manifest.json", json.dumps(manifest, indent=2))
    return manifest


def _hadoop(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _hadoop(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _hadoop(spark, path)
    fs.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _hadoop(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_lines(spark: SparkSession, path: str, lines, overwrite: bool = False) -> None:
    """A text file from a driver-side iterator, written beside its place in whatever store and then moved there."""
    if exists(spark, path) and not overwrite:
        raise FileExistsError(path)
    fs, part = _hadoop(spark, path + ".tmp")
    stream = fs.create(part, True)
    try:
        for line in lines:
            stream.write(bytearray(line.encode("utf-8")))
    finally:
        stream.close()
    remove(spark, path)
    fs.rename(part, _hadoop(spark, path)[1])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_lines(spark, path, [text], overwrite=True)


def bucketed(df: DataFrame, key: str, n: int, name: str = "_user_bucket") -> DataFrame:
    """With the hash bucket of a key, 0 to n - 1."""
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def write_buckets(df: DataFrame, path: str, key: str, n: int, files: int | None = None, overwrite: bool = False, name: str = "_user_bucket") -> DataFrame:
    """Parquet in one folder for each bucket of the key, each bucket written by one task; read back."""
    spark = df.sparkSession
    out = bucketed(df, key, n, name).repartition(files or n, name)
    out.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(name).parquet(path)
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, most: int = 64, overwrite: bool = False) -> DataFrame:
    """Parquet in ``most`` files at most; read back."""
    df.coalesce(most).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def _field(value) -> str:
    text = "" if value is None else str(value)
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\r\n') else text


def write_ordered_csv(df: DataFrame, path: str, keys: list[str], overwrite: bool = False, mark: str = "") -> int:
    """One CSV file in order of the keys: sorted in parallel, then drawn partition by partition through the driver."""
    rows, n = df.orderBy(*keys).toLocalIterator(prefetchPartitions=True), 0

    def lines():
        nonlocal n
        yield mark + ",".join(map(_field, df.columns)) + "\n"
        for row in rows:
            n += 1
            yield ",".join(map(_field, row)) + "\n"

    write_lines(df.sparkSession, path, lines(), overwrite)
    return n


def write_json_list(df: DataFrame, path: str, keys: list[str], overwrite: bool = False) -> int:
    """One JSON list in order of the keys."""
    rows, n = df.orderBy(*keys).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).toLocalIterator(prefetchPartitions=True), 0

    def lines():
        nonlocal n
        for row in rows:
            yield ("[\n" if not n else ",\n") + row[0]
            n += 1
        yield "[]\n" if not n else "\n]\n"

    write_lines(df.sparkSession, path, lines(), overwrite)
    return n


def write_statistics(df: DataFrame, path: str, keys: list[str], columns: list[str] | None = None, title: str = "Statistics") -> None:
    """A small table as path.csv (with a byte-order mark), path.json (no NaN) and path.md (a dash for null)."""
    spark, rows = df.sparkSession, [r.asDict() for r in df.orderBy(*keys).collect()]
    columns = columns or df.columns
    write_text(spark, f"{path}.json", json.dumps(rows, ensure_ascii=False, indent=2, allow_nan=False))
    write_text(spark, f"{path}.csv", "\ufeff" + "".join(",".join(map(_field, x)) + "\r\n" for x in [df.columns, *[list(r.values()) for r in rows]]))
    shown = lambda v: "—" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    body = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *["| " + " | ".join(shown(r[c]) for c in columns) + " |" for r in rows]]
    write_text(spark, f"{path}.md", f"# {title}\n\n" + "\n".join(body) + "\n")


def write_verified(df: DataFrame, path: str, partitions: int | None = None, overwrite: bool = False) -> int:
    """JSON lines, read again and counted; the count."""
    out = df.repartition(partitions) if partitions else df
    write_records(out, path, overwrite)
    return df.sparkSession.read.schema(df.schema).json(path).count()


class Runner:
    """Stages by name under one folder: a stage whose report is there is skipped, a failure leaves its own report."""

    def __init__(self, spark: SparkSession, folder: str, log=print):
        self.spark, self.folder, self.log = spark, folder, log

    def stage(self, name: str, outputs: list[str], run) -> dict:
        """The report of ``run()``, or of an earlier run if all its outputs exist; a report is a dict without NaN."""
        report = f"{self.folder}/{name}.json"
        if exists(self.spark, report) and all(exists(self.spark, x) for x in outputs):
            found = json.loads(read_text(self.spark, report))
            if finite(found):
                self.log(f"{name}: done before")
                return found | {"skipped": True}
        began = time.time()
        self.log(f"{name}: begins")
        try:
            found = run() or {}
            missing = [x for x in outputs if not exists(self.spark, x)]
            if missing or not finite(found):
                raise RuntimeError(f"{name} left no {', '.join(missing)}" if missing else f"{name} reports a number that is not finite")
        except Exception as error:
            write_text(self.spark, f"{self.folder}/{name}.failed.json", json.dumps({"status": "FAILED", "error": type(error).__name__, "message": str(error)[:2000]}))
            raise
        found = {"status": "OK", **found}
        write_text(self.spark, report, json.dumps(found | {"seconds": round(time.time() - began, 3)}, allow_nan=False))
        remove(self.spark, f"{self.folder}/{name}.failed.json")
        return found | {"skipped": False}

    def archive(self, name: str, path: str, suffix: str) -> str:
        """Moves an unfinished output aside, inside the folder only; the new place."""
        target = f"{path}.incomplete_{suffix}"
        if not path.startswith(self.folder.rstrip("/") + "/") or exists(self.spark, target):
            raise ValueError(f"{path} is not in {self.folder}, or {target} exists")
        fs, at = _hadoop(self.spark, path)
        fs.rename(at, _hadoop(self.spark, target)[1])
        remove(self.spark, f"{self.folder}/{name}.json")
        return target


def finite(value) -> bool:
    """Whether no number in a document is NaN or infinite."""
    if isinstance(value, float):
        return math.isfinite(value)
    return all(map(finite, value.values() if isinstance(value, dict) else value)) if isinstance(value, (dict, list)) else True
