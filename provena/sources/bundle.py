"""Bundles: tensors by slot with a manifest, written by Spark's committers; manifests read strictly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import contracts
from . import archive, shared

SCHEMA_NAME = "evidence_bundle_v1"


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON with a declared schema: malformed documents and missing fields fail the job."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    required = [F.when(F.col(f.name).isNull(), F.raise_error(F.lit(f"manifest field missing: {f.name}")).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) for f in T.StructType.fromDDL(schema)]
    return rows.select(*required)


def write(rows: DataFrame, path: str, slot: str) -> None:
    """Rows partitioned by slot; the committer makes the result appear at once or not at all."""
    rows.write.mode("overwrite").partitionBy(slot).parquet(path)


def manifest(rows: DataFrame, slot: str) -> DataFrame:
    """One row for each slot: path, rows and a digest of its rows' hashes (order does not matter)."""
    return rows.groupBy(slot).agg(F.count("*").alias("rows"), F.hex(F.bit_xor(F.xxhash64(*rows.columns))).alias("digest")).withColumn("path", F.concat(F.lit("tensors/"), F.replace(F.col(slot).cast("string"), F.lit("."), F.lit("/"))))


def write_tensors(tensors: DataFrame, path: str, archives: int = 16) -> DataFrame:
    """(slot, shape, content) rows as archives of tensor files, each of a share of the slots and written by a task of
    its own, and then their manifest, which appears whole or not at all and marks the bundle as complete. Returns
    the manifest."""
    spark = tensors.sparkSession
    files = tensors.select("slot", "shape", "content", F.concat(F.lit("tensors/"), F.replace(F.col("slot").cast("string"), F.lit("."), F.lit("/")), F.lit(".f32")).alias("path"))
    share = F.concat(F.lit("bundle-"), F.pmod(F.xxhash64(F.col("slot").cast("string")), F.lit(archives)).cast("string"))
    archive.write(files.select(share.alias("archive"), "path", "content"), f"{path}/files")
    entries = files.select(F.lit(SCHEMA_NAME).alias("schema"), F.col("slot").cast("string").alias("slot"), "path", "shape", F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("sha256"))
    shared.write_atomic(entries, f"{path}/manifest")
    return spark.read.schema(entries.schema).parquet(f"{path}/manifest")


def load_violations(manifest_: DataFrame, found: DataFrame, kinds: tuple[str, ...] = ("f32",), schema: str = SCHEMA_NAME) -> DataFrame:
    """The rules of a bundle: schema, unique slots and paths, paths below the root, positive shapes of known
    kind whose size is the declared length, and files of that length and hash. (rule, entity, detail) rows."""
    entity = F.col("slot")
    size = contracts.tensor_size(F.transform("shape", lambda s: s.cast("long")))
    rules = [
        contracts.violations(manifest_, "schema", entity, F.col("schema") != schema, F.col("schema")),
        contracts.violations(manifest_, "path", entity, ~(contracts.safe_path(F.col("path")) & contracts.below_root(F.col("path"))), F.col("path")),
        contracts.violations(manifest_, "kind", entity, ~F.col("kind").isin(*kinds), F.col("kind")),
        contracts.violations(manifest_, "shape", entity, (F.size("shape") == 0) | F.exists("shape", lambda s: s <= 0), F.array_join(F.transform("shape", lambda s: s.cast("string")), "x")),
        contracts.violations(manifest_, "length", entity, size != F.col("length"), F.col("length")),
        contracts.violations(contracts.duplicates(manifest_, "path"), "unique", F.col("path"), F.lit(True), F.col("n")),
        verify(manifest_.dropDuplicates(["path"]), found).select("rule", "entity", F.lit("").alias("detail")),
    ]
    return contracts.union(*rules)


def discover(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Files below a folder whose names match: path and length, no contents, each path once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length").dropDuplicates(["path"])


def verify(manifest_: DataFrame, found: DataFrame) -> DataFrame:
    """Manifest entries (path, length, sha256) against files (path, length, content): the violations."""
    have = found.select("path", F.col("length").alias("got_length"), F.sha2("content", 256).alias("got_sha"))
    both = manifest_.join(have, "path", "left")
    rule = F.when(F.col("got_length").isNull(), "missing").when(F.col("got_length") != F.col("length"), "size").when(F.lower("got_sha") != F.lower("sha256"), "sha256")
    return both.withColumn("rule", rule).filter("rule is not null").select("rule", F.col("path").alias("entity"))
