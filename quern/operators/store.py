"""Sorted files under a manifest: flush, merged reads, compaction, checkpoints, orphans.

A flush writes a table's live rows and tombstones as one Parquet dataset with the next sequence.
The manifest names the datasets; it is replaced by renaming one file, so a reader sees the files
before or after a change and nothing in between, and a failed write leaves orphans only.
"""

from __future__ import annotations

import copy
import json
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.errors import EngineError

FLUSH_ROWS, COMPACT_FILES = 4096, 4
FORMAT = 1


def newest(entries: DataFrame, key: str, seq: str = "_seq") -> DataFrame:
    """Of each key's entries the newest, tombstones among them; combined before the shuffle."""
    return entries.groupBy(key).agg(F.max_by(F.struct(*[c for c in entries.columns if c != key]), seq).alias("r")).select(key, "r.*")


def live(entries: DataFrame, key: str, seq: str = "_seq", tombstone: Column | None = None) -> DataFrame:
    """What a merged read shows: the newest entries without tombstones."""
    dead = F.col("_deleted") if tombstone is None else tombstone
    return newest(entries, key, seq).where(~dead)


def compact(entries: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """The live entries, dealt out by ranges of the key and sorted, ready to be written."""
    kept = live(entries, key)
    dealt = kept.repartitionByRange(partitions, key) if partitions else kept.repartitionByRange(key)
    return dealt.sortWithinPartitions(key)


def replay_order(log: DataFrame, order: str, width: int = 65_536) -> DataFrame:
    """order and pos, the place of each record by it from 1; null comes last.

    A prefix sum over blocks of `width` numbers, then places within a block: only the blocks' counts
    meet in one task.
    """
    block = F.coalesce(F.floor(F.col(order) / width), F.lit((1 << 63) - 1)).alias("_block")
    rows = log.select(order, block)
    counts = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_block", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy(order)) + F.col("_before")
    return rows.join(before, "_block").select(order, place.cast("bigint").alias("pos"))


def tombstones(entries: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Keys that earlier files show as live and the rows no longer have."""
    return live(entries, key).select(key).join(rows.select(key), key, "left_anti")


class Store:
    """Datasets of one folder and the manifest that names them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(folder))
        self.manifest = self._read() or {"format": FORMAT, "published": 0, "tables": {}}

    def _read(self) -> dict | None:
        path = f"{self.folder}/MANIFEST.json"
        if not self._fs.exists(self._path(path)):
            return None
        raw = self.spark.sparkContext.wholeTextFiles(path, 1).values().first()
        envelope = json.loads(raw)
        if zlib.crc32(envelope["body"].encode()) != envelope["crc32"]:
            raise EngineError("CorruptManifest", path)
        body = json.loads(envelope["body"])
        if body["format"] != FORMAT:
            raise EngineError("UnsupportedVersion", str(body["format"]))
        for table in body["tables"].values():
            for name in table["files"]:
                if not self._fs.exists(self._path(f"{self.folder}/{name}")):
                    raise EngineError("MissingFile", name)
        return body

    def _publish(self, manifest: dict) -> None:
        """Write beside, then rename over: one atomic step. Only then does memory follow."""
        body = json.dumps(manifest, sort_keys=True)
        part = self._path(f"{self.folder}/.manifest-{uuid.uuid4().hex}")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps({"body": body, "crc32": zlib.crc32(body.encode())}).encode()))
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(part, self._path(f"{self.folder}/MANIFEST.json"), options)
        self.manifest = manifest

    def _write(self, rows: DataFrame, name: str) -> str:
        target = f"{name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{target}")
        return target

    def entries(self, table: str) -> DataFrame:
        """All entries of a table's files, with their `_seq` and `_deleted`."""
        known = self.manifest["tables"][table]
        return self.spark.read.parquet(*[f"{self.folder}/{f}" for f in known["files"]])

    def scan(self, table: str) -> DataFrame:
        return live(self.entries(table), self.manifest["tables"][table]["key"]).drop("_seq", "_deleted")

    def lookup(self, table: str, key_value) -> DataFrame:
        """The newest entry of a key, a tombstone too; the key test reaches the files' statistics."""
        key = self.manifest["tables"][table]["key"]
        return newest(self.entries(table).where(F.col(key) == F.lit(key_value)), key)

    def _changed(self, table: str, key: str | None = None) -> tuple[dict, dict]:
        """A copy of the manifest to publish, and the table's entry in it."""
        new = copy.deepcopy(self.manifest)
        if key is not None:
            new["tables"].setdefault(table, {"key": key, "files": [], "level1": 0, "serial": 0})
        return new, new["tables"][table]

    def flush(self, table: str, rows: DataFrame, key: str) -> None:
        """The live rows as one more dataset, with tombstones for keys gone since earlier ones."""
        new, known = self._changed(table, key)
        seq = new["published"] + 1
        entries = rows.withColumn("_seq", F.lit(seq).cast("bigint")).withColumn("_deleted", F.lit(False))
        if known["files"]:
            gone = tombstones(self.entries(table), rows, key)
            entries = entries.unionByName(gone.withColumn("_seq", F.lit(seq).cast("bigint")).withColumn("_deleted", F.lit(True)), allowMissingColumns=True)
        known["files"].append(self._write(entries.repartitionByRange(key).sortWithinPartitions(key), table))
        new["published"] = seq
        self._publish(new)

    def compact(self, table: str) -> None:
        new, known = self._changed(table)
        known["files"] = [self._write(compact(self.entries(table), known["key"]), table)]
        known["level1"] = 1
        self._publish(new)

    def compaction_due(self) -> list[str]:
        """Tables with COMPACT_FILES or more datasets beside the compacted one."""
        return [t for t, k in sorted(self.manifest["tables"].items()) if len(k["files"]) - k["level1"] >= COMPACT_FILES]

    def checkpoint(self, tables: dict[str, tuple[DataFrame, str]]) -> None:
        for name, (rows, key) in tables.items():
            self.flush(name, rows, key)
        for name in self.compaction_due():
            self.compact(name)
        self.reclaim_orphans()

    def orphans(self) -> list[str]:
        named = {f for t in self.manifest["tables"].values() for f in t["files"]} | {"MANIFEST.json"}
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(f for f in found if f not in named and not f.endswith(".crc"))

    def reclaim_orphans(self) -> int:
        gone = self.orphans()
        for name in gone:
            self._fs.delete(self._path(f"{self.folder}/{name}"), True)
        return len(gone)

    def next_serial(self, table: str, n: int = 1) -> int:
        """The first of n new numbers; never given twice, whatever is deleted."""
        new, known = self._changed(table)
        known["serial"] += n
        self._publish(new)
        return known["serial"] - n + 1


def frame_checksum(payload: Column) -> Column:
    """CRC32 over a payload's length, four bytes little-endian, and the payload."""
    length = F.unhex(F.lpad(F.hex(F.octet_length(payload)), 8, "0"))
    return F.crc32(F.concat(_reversed(length), payload))


def _reversed(four: Column) -> Column:
    return F.concat(*[F.substring(four, i, 1) for i in (4, 3, 2, 1)])
