"""Tables and files as DataFrames."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A chat request's body.
CHAT_SCHEMA = "model string, messages array<struct<role:string,content:string>>, stream boolean"
MANIFEST_SCHEMA = "model string, version string, created_at string, files array<struct<path:string,sha256:string,size:bigint>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chat_requests(df: DataFrame, body: str, most_bytes: int) -> DataFrame:
    """Bodies decoded: ``request``, and ``status`` (200, 413 above the size limit, 400 if it isn't a JSON object)."""
    parsed = F.from_json(body, CHAT_SCHEMA, {"mode": "PERMISSIVE"})
    valid = F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT")
    status = F.when(F.octet_length(body) > most_bytes, 413).when(F.coalesce(valid, F.lit(False)), 200).otherwise(400)
    return df.withColumn("status", status).withColumn("request", F.when(F.col("status") == 200, parsed))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The files that a bundle's manifest lists: path, sha256, size."""
    return spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path).select("model", "version", F.inline("files"))


def bundle_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder: path below it, size and hash. The contents stay on the executors."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    below = F.regexp_replace("path", r"^[A-Za-z]+:/*", "/")
    root = "/" + folder.split(":", 1)[-1].strip("/") + "/"
    return raw.select(F.replace(below, F.lit(root), F.lit("")).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def bundle_faults(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Listed files that are missing, or of another size or hash."""
    own = found.select(F.col("path"), F.col("size").alias("own_size"), F.col("sha256").alias("own_sha256"))
    fault = F.when(F.col("own_size").isNull(), "missing").when(F.col("own_size") != F.col("size"), "size").when(F.lower("sha256") != F.col("own_sha256"), "sha256")
    return listed.join(own, "path", "left").withColumn("fault", fault).where(F.col("fault").isNotNull()).select("path", "fault")


def label_map(path: str) -> dict[int, str]:
    """Class labels from a JSON list or an id map."""
    found = json.loads(Path(path).read_text())
    found = found.get("id2label", found) if isinstance(found, dict) else found
    return {int(k): v for k, v in (enumerate(found) if isinstance(found, list) else found.items())}


def thresholds(text: str) -> dict[str, dict[str, float]]:
    """Warn and block thresholds by label from YAML (or JSON); a label without one of them lacks it."""
    from guardframe.plans.config import _parsed

    found = _parsed(text)
    found = found.get("thresholds", found)
    return {label: {k: float(v) for k, v in (levels or {}).items() if k in ("warn", "block") and v is not None} for label, levels in found.items()}


def state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small JSON state file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
