"""The state after a stream of changes, kept in buckets by key, so that a batch writes about as much as it changes.

A batch is reduced to the last change of each key and written as one delta file set, split by buckets.  A bucket whose
deltas have grown to a share of its base, or are many, is merged into a new base; others are left alone.  What
belongs to the state is named by a manifest, which is put in place last: a batch that fails or is retried begins again from
the manifest before it.  Readers merge a bucket's base and deltas by key.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: The bucket of a row, in the names of folders only.
BUCKET = "_bucket"


class Folder:
    """Files of small texts under a path of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.jvm = spark, root.rstrip("/"), spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str = "") -> list[str]:
        at = self._path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Readers see all of the text or nothing; what was there is replaced."""
        part = self._path(f".{uuid.uuid4().hex}")
        stream = self.fs.create(part)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.delete(self._path(name), False)
        self.fs.mkdirs(self._path(name).getParent())
        if not self.fs.rename(part, self._path(name)):
            raise OSError(f"cannot put {name} in place")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


@dataclass
class Manifest:
    """Of each bucket: the epoch of its base (-1: none), the base's rows, the epochs of its deltas and their rows."""

    epoch: int = -1
    schema: dict | None = None
    buckets: dict[str, dict] = field(default_factory=dict)


class BucketStore:
    """The rows of one table by key; see the module.

    ``order``: columns by which the last change of a key is told.  A row whose ``op`` is ``D`` is deleted; it stays
    in the files, so that an older change that comes late is not applied.  ``share`` and ``most``: deltas of a bucket, as a share
    of the rows of its base and in number, from which it is merged.  ``kept``: manifests whose files stay.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str], op: str, order: list[str], *, buckets: int = 64, share: float = 0.5, most: int = 16, kept: int = 2) -> None:
        self.spark, self.key, self.op, self.order = spark, key, op, order
        self.n, self.share, self.most, self.kept = buckets, share, most, max(1, kept)
        self.folder = Folder(spark, root)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.n)).cast("int")

    def epochs(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.folder.names("manifests") if n.endswith(".json")]

    def manifest(self, before: int | None = None) -> Manifest:
        """The last one (of an epoch before ``before``)."""
        found = [e for e in self.epochs() if before is None or e < before]
        return Manifest(**json.loads(self.folder.read(f"manifests/{max(found):012d}.json"))) if found else Manifest()

    def _data(self, kind: str, epoch: int) -> str:
        return f"{self.folder.root}/data/{epoch:012d}/{kind}"

    def _rows(self, m: Manifest, buckets: list[str]) -> DataFrame | None:
        """All versions of the keys in some buckets."""
        wanted: dict[str, list[str]] = {}
        for b in buckets:
            at = m.buckets[b]
            for kind, epoch in [*[("base", at["base"])] * (at["base"] >= 0), *[("delta", e) for e in at["deltas"]]]:
                wanted.setdefault(self._data(kind, epoch), []).append(f"{BUCKET}={b}")
        paths = [f"{top}/{b}" for top, bs in wanted.items() for b in bs]
        return self.spark.read.schema(StructType.fromJson(m.schema)).parquet(*paths) if paths else None

    def _last(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.key]
        last = F.max_by(F.struct(*rest), F.struct(*self.order))
        return rows.groupBy(*self.key).agg(last.alias("_r")).select(*self.key, *[F.col("_r")[c].alias(c) for c in rest])

    def _write(self, rows: DataFrame, kind: str, epoch: int) -> dict[str, int]:
        """Writes rows by bucket and counts them."""
        path = self._data(kind, epoch)
        rows.withColumn(BUCKET, self._bucket()).repartition(self.n, BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
        if not [n for n in self.folder.names(f"data/{epoch:012d}/{kind}") if n.startswith(BUCKET)]:
            return {}
        done = self.spark.read.parquet(path).groupBy(BUCKET).count().collect()  # at most one row for each bucket
        return {str(r[BUCKET]): r["count"] for r in done}

    def apply(self, changes: DataFrame, epoch: int) -> dict[str, int]:
        """Applies a batch and gives the rows written: ``delta`` and ``base``.  The same epoch again replaces what it did."""
        m = self.manifest(before=epoch)
        schema = self._merged(StructType.fromJson(m.schema) if m.schema else StructType([]), changes.schema)
        delta = self._write(self._last(changes.select(*[F.col(f.name) if f.name in changes.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])), "delta", epoch)
        new = Manifest(epoch, schema.jsonValue(), {b: dict(v) for b, v in m.buckets.items()})
        for b, n in delta.items():
            at = new.buckets.setdefault(b, {"base": -1, "rows": 0, "deltas": [], "changed": 0})
            at["deltas"], at["changed"] = [*at["deltas"], epoch], at["changed"] + n
        full = [b for b, at in new.buckets.items() if b in delta and (at["changed"] > self.share * at["rows"] or len(at["deltas"]) > self.most)]
        base = {}
        if full:
            base = self._write(self._last(self._rows(new, full)), "base", epoch)
            for b in full:
                new.buckets[b] = {"base": epoch, "rows": base[b], "deltas": [], "changed": 0}
        self.folder.write(f"manifests/{epoch:012d}.json", json.dumps(new.__dict__))
        self._clean()
        return {"delta": sum(delta.values()), "base": sum(base.values())}

    def _merged(self, old: StructType, new: StructType) -> StructType:
        known = {f.name: f for f in old}
        for f in new:
            if f.name in known and known[f.name].dataType != f.dataType:
                raise ValueError(f"column {f.name} was {known[f.name].dataType.simpleString()} and is {f.dataType.simpleString()}")
        return StructType([StructField(f.name, f.dataType, True) for f in [*old, *[f for f in new if f.name not in known]]])

    def _clean(self) -> None:
        """Deletes what none of the last manifests names."""
        epochs = self.epochs()
        stay = [Manifest(**json.loads(self.folder.read(f"manifests/{e:012d}.json"))) for e in epochs[-self.kept :]]
        used = {("base", at["base"]) for m in stay for at in m.buckets.values()} | {("delta", e) for m in stay for at in m.buckets.values() for e in at["deltas"]}
        for e in epochs[: -self.kept]:
            self.folder.delete(f"manifests/{e:012d}.json")
        for name in self.folder.names("data"):
            kinds = self.folder.names(f"data/{name}")
            for kind in kinds:
                if (kind, int(name)) not in used:
                    self.folder.delete(f"data/{name}/{kind}")
            if not any((kind, int(name)) in used for kind in kinds):
                self.folder.delete(f"data/{name}")

    def versions(self) -> DataFrame | None:
        """The last change of each key, deletions included; None before the first batch."""
        m = self.manifest()
        rows = self._rows(m, list(m.buckets))
        if rows is None:
            return self.spark.createDataFrame([], StructType.fromJson(m.schema)) if m.schema else None
        return self._last(rows)

    def current(self) -> DataFrame:
        """The rows that are not deleted."""
        rows = self.versions()
        if rows is None:
            raise FileNotFoundError(f"no batch was applied to {self.folder.root}")
        return rows.where(F.col(self.op) != "D").drop(self.op)


def key_changes(changes: DataFrame, key: str, old_key: str, op: str) -> DataFrame:
    """Updates that change the key, as a deletion under the old one and an insertion under the new one; ``old_key`` goes."""
    moved = (F.col(op) == "U") & F.col(old_key).isNotNull() & (F.col(old_key) != F.col(key))
    rest = [c for c in changes.columns if c not in (key, old_key, op)]
    pair = F.array(F.struct(F.col(old_key).alias(key), F.lit("D").alias(op)), F.struct(F.col(key).alias(key), F.lit("I").alias(op)))
    one = F.array(F.struct(F.col(key).alias(key), F.col(op).alias(op)))
    return changes.withColumn("_c", F.explode(F.when(moved, pair).otherwise(one))).select(F.col("_c")[key].alias(key), F.col("_c")[op].alias(op), *rest)


def replay_into(changes: DataFrame, store: BucketStore, checkpoint: str, reason: Column | None = None, most: int | None = None):
    """Applies a stream of changes to a store; those with a ``reason`` go to its quarantine instead, a folder for each epoch.

    ``most`` bounds the epochs of this run, for a replay that is to stop and go on later.
    """
    done = []

    def one(batch: DataFrame, epoch: int) -> None:
        if most is not None and len(done) >= most:
            raise StopReplay(f"stopped after {most} batches")
        good = batch
        if reason is not None:
            batch = batch.withColumn("_reason", reason)
            bad = batch.where("_reason is not null").withColumnRenamed("_reason", "reason")
            bad.write.mode("overwrite").parquet(f"{store.folder.root}/quarantine/epoch={epoch}")
            good = batch.where("_reason is null").drop("_reason")
        store.apply(good, epoch)
        done.append(epoch)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class StopReplay(RuntimeError):
    """A replay that reached its number of batches; the checkpoint goes on from there."""
