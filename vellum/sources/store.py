"""A stored table of chunks in generations: upserts and deletes write what they touch, readers pin a generation.

Rows are dealt to slots, by tenant and by a hash of the document. A write makes a new generation:
it writes the touched slots anew, whole, into a folder of its own, and then names, in one small
file that appears at once, the folder that holds each slot. What earlier generations name is
never written again, so a reader that holds a generation sees the same rows throughout, and a
write that dies leaves the table as it was. Two writers can't make the same generation: the
second gets :class:`FileExistsError` and starts again.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import Folder

KEY = ["tenant", "doc_id"]


def _tenant_slots(tenant: str) -> str:
    return hashlib.sha1(str(tenant).encode()).hexdigest()[:16]


class Generation:
    """What one generation consists of: its number, the rows' schema, and the folder of each slot."""

    def __init__(self, number: int, schema: str | None, slots: dict[str, str]):
        self.number, self.schema, self.slots = number, schema, slots


class ChunkStore:
    """Chunks (tenant, doc_id, chunk_index, ...) below ``path``; every row has a tenant and a document.

    ``buckets`` slots a tenant: as many as its documents should be rewritten in. The file that
    names a generation has an entry for each slot, so it grows with tenants and buckets and not
    with rows. Several chunks of a document are its rows, whatever their other columns.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 8):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._log, self._data = Folder(spark, f"{self.path}/generations"), Folder(spark, f"{self.path}/data")

    def numbers(self) -> list[int]:
        """The generations that can be read, oldest first."""
        return [int(n.split(".")[0]) for n in self._log.names()]

    def generation(self, number: int | None = None) -> Generation:
        """A generation, the newest by default; number 0 is the empty table."""
        numbers = self.numbers()
        number = (numbers[-1] if numbers else 0) if number is None else number
        if number == 0:
            return Generation(0, None, {})
        if number not in numbers:
            raise LookupError(f"generation {number} isn't kept")
        told = json.loads(self._log.read(f"{number:012d}.json"))
        return Generation(number, told["schema"], told["slots"])

    def read(self, number: int | None = None, tenants: list[str] | None = None) -> DataFrame:
        """The rows of a generation, of some tenants only: their slots alone are opened."""
        return self._rows(self.generation(number), tenants)

    def _rows(self, at: Generation, tenants: list[str] | None = None, only: set[str] | None = None) -> DataFrame:
        if at.schema is None:
            return self.spark.createDataFrame([], "tenant string, doc_id long")
        wanted = None if tenants is None else {_tenant_slots(t) for t in tenants}
        slots = [s for s in at.slots if (wanted is None or s.split("-")[0] in wanted) and (only is None or s in only)]
        schema = StructType.fromJson(json.loads(at.schema))
        if not slots:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self._data.path}/{at.slots[s]}/slot={s}" for s in slots])
        return rows if tenants is None else rows.where(F.col("tenant").isin(*tenants))

    def _slot(self) -> Column:
        part = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(self.buckets))
        return F.concat_ws("-", F.substring(F.sha1(F.col("tenant").cast("string").cast("binary")), 1, 16), part.cast("string"))

    def _commit(self, before: Generation, schema: str | None, slots: dict[str, str]) -> int:
        self._log.put(f"{before.number + 1:012d}.json", json.dumps({"schema": schema, "slots": slots}))
        return before.number + 1

    def upsert(self, chunks: DataFrame, documents: DataFrame | None = None) -> int:
        """Replace whole documents, and give the new generation's number; without any document nothing is written.

        ``documents`` (tenant, doc_id) names those that are replaced: one without chunks is left
        without any. By default these are the documents of ``chunks``. A null tenant or document
        is refused, as nothing could delete it.
        """
        touched = (chunks if documents is None else documents).select(*KEY).distinct()
        if not touched.where("tenant is null or doc_id is null").isEmpty():
            raise ValueError("every chunk needs a tenant and a document")
        return self._write(chunks, touched)

    def delete(self, documents: DataFrame) -> int:
        """Take documents (tenant, doc_id) away; those that aren't there, and rows without a tenant, take nothing. Gives the generation's number."""
        return self._write(None, documents.select(*KEY).where("tenant is not null").distinct())

    def delete_tenant(self, tenant: str) -> int:
        """Take a tenant away. Only the file that names the generation is written."""
        before = self.generation()
        left = {s: folder for s, folder in before.slots.items() if s.split("-")[0] != _tenant_slots(tenant)}
        return before.number if len(left) == len(before.slots) else self._commit(before, before.schema, left)

    def _write(self, chunks: DataFrame | None, touched: DataFrame) -> int:
        before = self.generation()
        slots = {r["slot"] for r in touched.select(self._slot().alias("slot")).distinct().collect()}  # at most a row for each slot
        if chunks is None:
            slots &= set(before.slots)
        if not slots or (chunks is None and before.schema is None):
            return before.number
        rows = chunks
        if before.schema is not None:
            old = self._rows(before, only=slots).join(touched, KEY, "left_anti")
            rows = old if chunks is None else old.unionByName(chunks, allowMissingColumns=True)
        folder = uuid.uuid4().hex
        # a slot is one file: its rows meet in one task, and there are as many tasks as slots at most
        rows.withColumn("slot", self._slot()).repartition("slot").write.partitionBy("slot").parquet(f"{self._data.path}/{folder}")
        written = {n.removeprefix("slot=") for n in self._data.names(folder) if n.startswith("slot=")}
        kept = {s: f for s, f in before.slots.items() if s not in slots}
        return self._commit(before, rows.schema.json(), kept | dict.fromkeys(sorted(written), folder))

    def expire(self, keep: int = 2) -> list[str]:
        """Forget all generations but the last ``keep``, and the slots' files that none of these names. Don't run it while a write is under way."""
        numbers = self.numbers()
        used = {f"{folder}/slot={s}" for n in numbers[-keep:] for s, folder in self.generation(n).slots.items()}
        for n in numbers[:-keep]:
            self._log.remove(f"{n:012d}.json")
        gone = [at for folder in self._data.names() for slot in self._data.names(folder) if (at := f"{folder}/{slot}") not in used]
        for at in gone:
            self._data.remove(at)
        return gone
