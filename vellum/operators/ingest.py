"""Ingests that write only what changed: plan by fingerprints, chunk, embed, store, and then the manifest.

A document's chunks are replaced whole, so an ingest that dies after the chunks were stored and
before the manifest was, does the same again when it is repeated, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.shared import stored
from ..sources.store import ChunkStore
from .maintain import load_manifest, manifest, plan, same_contract, save_manifest

Cut = Callable[[DataFrame], DataFrame]


def _named(tenant: str = "tenant", doc_id: str = "doc_id"):
    """One name for tenant and document, whatever they hold."""
    return F.to_json(F.struct(F.col(tenant).cast("string").alias("t"), F.col(doc_id).cast("string").alias("d")))


def ingest(store: ChunkStore, docs: DataFrame, cut: Cut, contract: dict, path: str, whole: bool = True) -> dict:
    """Bring ``store`` up to ``docs`` (tenant, doc_id, text); counts of what was built, deleted and kept, and the generation.

    ``cut`` makes chunks (tenant, doc_id, chunk_index, ...) of the documents it is given: those
    that are new or changed, or all if there is no manifest below ``path`` that can be read, the
    store is empty, or the contract is another. ``docs`` are all documents there are, and others
    are deleted, unless not ``whole``: then they are the ones to look at. An empty text leaves a
    document without chunks. Where nothing changed nothing is written, neither chunks nor manifest.
    """
    spark = docs.sparkSession
    rows = docs.select("tenant", "doc_id", "text", _named().alias("name"))
    after = stored(manifest(rows.select(F.col("name").alias("doc_id"), "text")), "manifest")
    found = load_manifest(spark, path)
    rebuild = found is None or not same_contract(contract, found[1]) or not store.generation().slots
    nothing = spark.createDataFrame([], "doc_id string, sha1 string, chunks long")
    before = nothing if found is None else found[0]
    looked_at = before if whole else before.join(after.select("doc_id"), "doc_id", "left_semi")
    steps = stored(plan(looked_at, after, rebuild), "plan")
    n = {r["action"]: r["n"] for r in steps.groupBy("action").agg(F.count("*").alias("n")).collect()}  # three rows at most
    counts = {"built": n.get("build", 0), "deleted": n.get("delete", 0), "kept": n.get("keep", 0)}
    if not counts["built"] and not counts["deleted"] and found is not None:
        return {**counts, "generation": store.generation().number}
    built = rows.join(steps.where("action = 'build'").select(F.col("doc_id").alias("name")), "name", "left_semi")
    chunks = stored(cut(built.drop("name")), "chunks")
    gone = steps.where("action = 'delete'").select(F.from_json("doc_id", "t string, d string").alias("k")).select(F.col("k.t").alias("tenant"), F.col("k.d").cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"))
    if rebuild and whole and store.generation().slots:  # what no manifest names goes as well
        gone = gone.unionByName(store.read().select("tenant", "doc_id").distinct().join(rows.select("tenant", "doc_id"), ["tenant", "doc_id"], "left_anti"))
    number = store.upsert(chunks, built.select("tenant", "doc_id").unionByName(gone))
    sizes = chunks.select(_named().alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("made"))
    old = before.select("doc_id", F.col("chunks").alias("had"))
    new = after.join(sizes, "doc_id", "left").join(steps.select("doc_id", "action"), "doc_id").join(old, "doc_id", "left")
    new = new.select("doc_id", "sha1", F.when(F.col("action") == "build", F.coalesce("made", F.lit(0))).otherwise(F.coalesce("had", F.lit(0))).alias("chunks"))
    if not whole:
        new = new.unionByName(before.join(after.select("doc_id"), "doc_id", "left_anti"))
    save_manifest(new, contract, path)
    return {**counts, "generation": number}


def ingest_stream(documents: DataFrame, store: ChunkStore, cut: Cut, contract: dict, path: str, checkpoint: str) -> DataStreamWriter:
    """Ingest a stream of documents, micro-batch by micro-batch; of a document that a batch holds several times the last (seq) stands.

    A batch that is run again after a failure finds its documents in the manifest, or builds
    them again to the same end. Start the writer that is returned.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("tenant", "doc_id").agg(F.max_by("text", "seq").alias("text"))
        ingest(store, stored(newest, "batch"), cut, contract, path, whole=False)

    return documents.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
