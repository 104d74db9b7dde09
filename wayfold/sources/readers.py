"""Readers of the supported inputs; every one keeps the schema explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "user_id string, poiid string, new_key_type string, longitude string, latitude string, log_time string"
POLYGONS = "array<array<array<array<double>>>>"


def events_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Raw events, numbers as strings; a malformed line is a row of nulls."""
    return spark.read.schema(EVENT_SCHEMA).json(path)


def checkins_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless check-ins of exactly eight tab-separated fields; other lines are dropped."""
    names = ("user_id", "poi_id", "category_id", "category_name", "latitude", "longitude", "tz_offset_min", "utc_time")
    lines = spark.read.option("encoding", "ISO-8859-1").option("sep", "\u0001").option("quote", "").schema("value string").csv(path)
    parts = lines.select(F.split("value", "\t").alias("x")).where(F.size("x") == len(names))
    typed = parts.select(*[F.col("x")[i].alias(n) for i, n in enumerate(names)])
    when = F.try_to_timestamp(F.regexp_replace("utc_time", r"^\w{3}\s+", ""), F.lit("MMM dd HH:mm:ss Z yyyy"))
    return typed.withColumns({"latitude": F.col("latitude").try_cast("double"), "longitude": F.col("longitude").try_cast("double"), "tz_offset_min": F.col("tz_offset_min").try_cast("int"), "time": when})


def table_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def events_counted(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, one row of rows and dropped): lines that are no object or lack a field are dropped and counted."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("value")).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", EVENT_SCHEMA).alias("e"))
    names = [f.split()[0] for f in EVENT_SCHEMA.split(", ")]
    good = F.coalesce(F.col("e").isNotNull() & F.forall(F.array(*[F.col(f"e.{n}") for n in names]), lambda x: x.isNotNull() & (x != "")), F.lit(False))
    report = parsed.agg(F.count("*").alias("rows"), F.count_if(~good).alias("dropped"))
    return parsed.where(good).select("e.*"), report


def records(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """JSON lists and JSON lines, each file told apart by its first character; file and row keep the order.

    A file that begins with a bracket is one document, parsed whole by one task; all others are lines.
    Members that are no objects give no row.  ``limit`` keeps the first rows in order of file and row.
    """
    first = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"), F.regexp_replace("value", "^\ufeff", "").alias("value")).where(F.trim("value") != "")
    kinds = first.groupBy("file").agg(F.min(F.struct("row", F.ltrim("value").startswith("[").alias("whole"))).alias("f")).select("file", "f.whole")
    known = {r.file: r.whole for r in kinds.collect()}  # one row for each file
    whole, lines = [f for f, w in known.items() if w], [f for f, w in known.items() if not w]
    parts = []
    if lines:
        one = first.where(F.col("file").isin(lines)) if whole else first
        parts.append(one.select("file", "row", F.from_json("value", schema).alias("r")).where("r is not null"))
    if whole:
        text = spark.read.text(whole, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
        members = text.select("file", F.posexplode(F.from_json("value", "array<string>")).alias("row", "value"))
        parts.append(members.where(F.ltrim("value").startswith("{")).select("file", F.col("row").cast("long").alias("row"), F.from_json("value", schema).alias("r")))
    found = parts[0] if parts else spark.createDataFrame([], f"file string, row long, r struct<{schema_fields(schema)}>")
    found = found.unionByName(parts[1]) if len(parts) > 1 else found
    if limit is not None:
        found = found.orderBy("file", "row").limit(limit)
    return found.select("r.*", "file", "row")


def schema_fields(schema: str) -> str:
    """``a int, b string`` as the fields of a struct type."""
    return ", ".join(f"{name}: {kind}" for name, kind in (x.strip().split(" ", 1) for x in schema.split(",")))


def json_list(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """The objects of one JSON list in their order; any other document is an error, other members are dropped."""
    text = spark.read.text(path, wholetext=True).select(F.trim(F.regexp_replace("value", "^\ufeff", "")).alias("value"))
    bad = F.raise_error(F.lit("the document is not a JSON list")).cast("array<string>")
    members = F.when(F.col("value").startswith("["), F.coalesce(F.from_json("value", "array<string>"), bad)).otherwise(bad)
    found = text.select(F.posexplode(members).alias("row", "value")).where(F.ltrim("value").startswith("{"))
    found = found.select("row", F.from_json("value", schema).alias("r")).select("row", "r.*")
    return found.orderBy("row").limit(limit) if limit is not None else found


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """code, name, shape of a feature collection; polygons become one-part multipolygons."""
    whole = spark.read.schema("features array<struct<properties: struct<adcode: string, name: string>, geometry: struct<type: string, coordinates: string>>>").option("multiLine", True).json(path)
    f = whole.select(F.explode("features").alias("f")).select("f.properties.*", "f.geometry.*")
    many, one = F.from_json("coordinates", POLYGONS), F.array(F.from_json("coordinates", POLYGONS[6:-1]))
    return f.select(F.col("adcode").alias("code"), "name", F.when(F.col("type") == "Polygon", one).otherwise(many).alias("shape"))


#: The codes of province-level cities.
PROVINCES = ("110000", "120000", "310000", "500000", "810000", "820000")


def boundaries(spark: SparkSession, provinces: str | None, cities: str | None) -> DataFrame:
    """code, name, shape: the province-level cities of one file, and all features of the others (``*_full.json``)."""
    found = []
    if provinces:
        found.append(geojson(spark, provinces).where(F.col("code").isin(*PROVINCES)))
    if cities:
        found.append(geojson(spark, cities))
    if not found:
        raise ValueError("no boundary files are given")
    return found[0].unionByName(found[1]) if len(found) > 1 else found[0]


def vectors(spark: SparkSession, path: str, rows: int = 1000) -> DataFrame:
    """pid, v of archives (.npz) with pids and embeddings, or of pickled dicts of lists and arrays.

    Each file is opened by the task that reads it and sent on in batches; ids must be unique and values
    finite, which is checked when the result is read.  A pickle may hold arrays and plain values only.
    """

    def unpack(batches):
        import io
        import pickle

        import numpy as np
        import pyarrow as pa

        class Plain(pickle.Unpickler):
            def find_class(self, module, name):
                if module.split(".")[0] == "numpy" and name in ("_reconstruct", "ndarray", "dtype", "scalar", "_frombuffer"):
                    return super().find_class(module, name)
                raise pickle.UnpicklingError(f"{module}.{name} is no plain value")

        for batch in batches:
            for data in batch.column("content").to_pylist():
                if data[:2] == b"PK":
                    with np.load(io.BytesIO(data)) as z:
                        pids, found = z["pids"], z["embeddings"]
                else:
                    held = Plain(io.BytesIO(data)).load()
                    pids, found = (held["pids"], held["embeddings"]) if "pids" in held else (list(held), list(held.values()))
                pids, found = np.asarray(pids, np.int64), np.asarray(found, np.float32)
                for at in range(0, len(pids), rows):
                    part = np.ascontiguousarray(found[at : at + rows])
                    offsets = pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(pids[at : at + rows]), pa.ListArray.from_arrays(offsets, pa.array(part.ravel()))], ["pid", "v"])

    from ..operators.checks import all_finite, unique

    return unique(all_finite(spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "pid long, v array<float>"), [], ["v"]), "pid")


def renamed(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns under the names that aliases lead to: an exact name first, then whatever its case, in order of the candidates."""
    lower = {c.lower(): c for c in df.columns}
    found = {}
    for name, candidates in aliases.items():
        hit = next((c if c in df.columns else lower[c.lower()] for c in candidates if c in df.columns or c.lower() in lower), None)
        if hit is None:
            raise ValueError(f"none of {', '.join(candidates)} is among {', '.join(df.columns)}")
        found[hit] = name
    return df.withColumnsRenamed(found)


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
