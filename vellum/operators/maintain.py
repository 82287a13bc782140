"""Fingerprints, manifests and the changes that follow from them; upserts and deletes."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import Folder, stored

SCHEMA_VERSION = 2
CONTRACT = ("schema_version", "chunk_size", "chunk_overlap")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, sha1 of every document."""
    return docs.select("doc_id", F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("sha1"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, change ("added", "changed", "removed", "same"), chunks carried over for what is the same."""
    b = before.select(F.col("doc_id").alias("b_id"), F.col("sha1").alias("b_sha"), F.col("chunks").alias("b_chunks"))
    joined = after.join(b, F.col("doc_id") == F.col("b_id"), "full_outer")
    change = F.when(F.col("b_id").isNull(), "added").when(F.col("doc_id").isNull(), "removed").when(F.col("sha1").eqNullSafe(F.col("b_sha")), "same").otherwise("changed")
    return joined.select(F.coalesce("doc_id", "b_id").alias("doc_id"), change.alias("change"), F.when(change == "same", F.coalesce("b_chunks", F.lit(0))).alias("chunks"))


def same_contract(a: dict, b: dict | None) -> bool:
    """Whether an index can be kept: equal schema version, chunk size and overlap."""
    return b is not None and all(a.get(k) == b.get(k) for k in CONTRACT)


def save_manifest(docs: DataFrame, contract: dict, path: str) -> None:
    """Write a manifest (doc_id, sha1, chunks) with its contract as the newest version below ``path``.

    The rows are written first; the small file that names them, with their number and the
    contract, appears at once and makes the version. So an empty manifest is a version too, a
    reader never sees half of one, and the versions before it stay. Of two writers of one
    version the second gets FileExistsError.
    """
    versions = Folder(docs.sparkSession, f"{path}/versions")
    number = max((int(n.split(".")[0]) for n in versions.names()), default=0) + 1
    rows = f"{path}/rows/{uuid.uuid4().hex}"
    docs.select("doc_id", "sha1", "chunks").write.parquet(rows)
    n = docs.sparkSession.read.parquet(rows).count()
    versions.put(f"{number:012d}.json", json.dumps({"contract": {k: contract[k] for k in CONTRACT}, "rows": rows, "n": n}))


def load_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, dict] | None:
    """The newest manifest below ``path`` and its contract; None where there is none or it can't be read whole, and all has to be rebuilt."""
    versions = Folder(spark, f"{path}/versions")
    if not (names := versions.names()):
        return None
    try:
        told = json.loads(versions.read(names[-1]))
        rows = spark.read.parquet(told["rows"]).select("doc_id", "sha1", "chunks")
        whole = rows.agg(F.count("*").alias("n"), F.max(F.xxhash64("doc_id", "sha1", "chunks"))).first()["n"] == told["n"]  # reads every value
        return (rows, {k: told["contract"][k] for k in CONTRACT}) if whole else None
    except (AnalysisException, Py4JJavaError, PySparkException, ValueError, KeyError, TypeError):
        return None


def total_chunks(docs: DataFrame) -> DataFrame:
    """One row: documents and chunks of a manifest."""
    return docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


def versions(writes: DataFrame) -> DataFrame:
    """``writes`` (tenant, seq) with ``kb_version``: how many writes a tenant's documents have seen, this one included.

    Writes are numbered within ranges of tenant and seq, and each range begins with the number of
    those before it: a tenant with very many writes is many tasks.
    """
    dealt = stored(writes.repartitionByRange("tenant", "seq").withColumn("range_", F.spark_partition_id()), "writes")
    sizes = dealt.groupBy("tenant", "range_").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("tenant").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of the tenant
    before = sizes.select(F.col("tenant").alias("t_"), F.col("range_").alias("r_"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before_"))
    own = F.row_number().over(Window.partitionBy("tenant", "range_").orderBy("seq"))
    numbered = dealt.withColumn("own_", own).join(before, F.col("tenant").eqNullSafe(F.col("t_")) & (F.col("range_") == F.col("r_")))
    return numbered.select(*writes.columns, (F.col("own_") + F.col("before_")).alias("kb_version"))


def plan(before: DataFrame, after: DataFrame, rebuild: bool, failed: Column | None = None) -> DataFrame:
    """doc_id, action: what an ingest does. ``rebuild`` (no manifest, another contract, an empty index) builds everything.

    A document whose parsing failed (``failed`` over ``after``) is marked and tried again next
    time, instead of being recorded as done.
    """
    found = diff(before, after)
    action = F.when(F.col("change") == "removed", "delete").when(F.lit(rebuild) | F.col("change").isin("added", "changed"), "build").otherwise("keep")
    planned = found.select("doc_id", "change", action.alias("action"))
    if failed is None:
        return planned
    bad = after.where(failed).select("doc_id").withColumn("bad", F.lit(True))
    return planned.join(bad, "doc_id", "left").select("doc_id", "change", F.when(F.col("bad") & (F.col("action") == "build"), "failed").otherwise(F.col("action")).alias("action"))


def upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``stored`` with every group of rows that shares a key with ``new`` replaced by the new rows."""
    return stored.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def delete(stored: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """``stored`` without the rows whose key is in ``gone``. Tenant (and user) belong in every key; nothing deletes across them."""
    if "tenant" not in key:
        raise ValueError("a delete is always of one tenant: put tenant into the key")
    return stored.join(gone.select(*key).distinct(), key, "left_anti")


def removed(stored: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """``key``, n: how many rows :func:`delete` takes away for each key in ``gone``; 0 where there is none."""
    keys = gone.select(*key).distinct()
    return keys.join(stored.groupBy(*key).agg(F.count("*").alias("found")), key, "left").select(*key, F.coalesce("found", F.lit(0)).alias("n"))


def to_rebuild_and_remove(found: DataFrame) -> DataFrame:
    """doc_id, action of a :func:`diff`, sorted: what has to be built again, and what goes."""
    action = F.when(F.col("change") == "removed", "remove").when(F.col("change") != "same", "rebuild")
    return found.select("doc_id", action.alias("action")).where("action is not null").orderBy("action", "doc_id")


def visible(docs: DataFrame, tenant: str, shared: str | None = None) -> DataFrame:
    """Rows of a tenant and of the shared one; a predicate that reaches the scan."""
    return docs.where(F.col("tenant").isin(tenant, shared) if shared else F.col("tenant") == tenant)


def listing(chunks: DataFrame, by_tenant: bool = True) -> DataFrame:
    """Documents with title and number of chunks. Without ``by_tenant`` equal ids of two tenants are one, as they were seen first (seq)."""
    key = ["tenant", "doc_id"] if by_tenant else ["doc_id"]
    first = [F.min_by(c, "seq").alias(c) for c in ("title", "tenant") if c not in key]
    return chunks.groupBy(*key).agg(*first, F.count("*").alias("chunks"))


def tenants_of(calls: DataFrame, tenants: DataFrame, default: str = "default") -> DataFrame:
    """Calls with the tenant of their API key. Of a key given twice the last (seq) stands; blank keys are none."""
    known = tenants.where(F.btrim("api_key") != "").groupBy("api_key").agg(F.max_by("tenant_id", "seq").alias("tenant_id"))
    return calls.join(known, "api_key", "left").withColumn("tenant_id", F.when(F.col("tenant_id") == "", default).otherwise(F.col("tenant_id")))
