"""A record store on Parquet: a base, layers of changes, and numbered manifests."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import indexing

RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("document", T.StringType()),
        T.StructField("leaf_folder", T.StringType()),
        T.StructField("representative_image", T.StringType()),
        T.StructField("member_count", T.IntegerType()),
        T.StructField("rep_method", T.StringType()),
        T.StructField("model_id", T.StringType()),
        T.StructField("embed_dim", T.IntegerType()),
        T.StructField("granularity", T.StringType()),
        T.StructField("mtime", T.StringType()),
        T.StructField("caption", T.StringType()),
        T.StructField("sidecar_text", T.StringType()),
    ]
)


GONE = "_gone"


class SnapshotStore:
    """Records by id under ``root``, on any file system that Spark reads.

    The store is a base and layers of changes over it, each a Parquet folder; a numbered manifest names them. A
    change writes one layer, with the changed records only, and then the next manifest under a name of its own, so
    a change either is there whole or not at all, readers go on reading what they began with, and what is written is as
    large as the change. A change that alters nothing writes no manifest. Once the layers are many, or have more than a
    quarter of the records of the base, the change writes a new base. One writer at a time; of two that meet, the
    second fails. ``version`` grows with every change and lasts beyond the process.
    """

    MANY = 16  # layers
    FEW_IDS = 1_000_000  # ids of changed records that readers may send to every task

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType = RECORD):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._text = lambda stream: jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        self._layer_schema = T.StructType([*schema, T.StructField(GONE, T.BooleanType())])

    # the manifest
    def _manifests(self) -> list[str]:
        at = self._path(self.root)
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted((n for n in names if n.startswith("manifest-")), reverse=True)

    def _manifest(self) -> dict:
        """The highest one that is whole."""
        for name in self._manifests():
            stream = self._fs.open(self._path(f"{self.root}/{name}"))
            try:
                return json.loads(self._text(stream))
            except ValueError:
                continue
            finally:
                stream.close()
        return {"version": 0, "base": None, "layers": [], "signature": None}

    def _publish(self, manifest: dict) -> None:
        name = f"manifest-{manifest['version']:010d}.json"
        new, at = self._path(f"{self.root}/.{name}-{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        stream = self._fs.create(new, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if self._fs.exists(at) or not self._fs.rename(new, at):
            self._fs.delete(new, False)
            raise RuntimeError(f"version {manifest['version']} of {self.root} was written by another")

    def _write(self, df: DataFrame, kind: str, version: int, schema: T.StructType) -> dict:
        name = f"{kind}-{version:010d}-{uuid.uuid4().hex[:8]}"
        df.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.parquet(f"{self.root}/{name}")
        return {"path": name, "rows": self.spark.read.parquet(f"{self.root}/{name}").count()}

    def _commit(self, changes: DataFrame | None, signature=None, reset: bool = False) -> bool:
        """Write records and, with ``GONE``, deletions; ids are unique. Returns whether anything changed."""
        before = self._manifest()
        after = dict(before, version=before["version"] + 1, signature=list(signature) if signature else before["signature"])
        if reset:
            after |= {"base": None, "layers": []}
        first = not after["base"] and not after["layers"]
        new = {"rows": 0}
        if changes is not None:
            new = self._write(changes.filter(~F.col(GONE)), "base", after["version"], self.schema) if first else self._write(changes, "layer", after["version"], self._layer_schema)
        if new["rows"]:
            after |= {"base": new} if first else {"layers": [*after["layers"], new]}
        elif not (reset and (before["base"] or before["layers"])):
            return False
        changed, base = sum(x["rows"] for x in after["layers"]), after["base"]["rows"] if after["base"] else 0
        if changed > base / 4 or len(after["layers"]) > self.MANY:
            after |= {"base": self._write(self._read(after), "base", after["version"], self.schema), "layers": []}
        self._publish(after)
        return True

    def _read(self, manifest: dict) -> DataFrame:
        base = self.spark.read.schema(self.schema).parquet(f"{self.root}/{manifest['base']['path']}") if manifest["base"] else self.spark.createDataFrame([], self.schema)
        if not manifest["layers"]:
            return base
        layers = None
        for n, layer in enumerate(manifest["layers"]):
            one = self.spark.read.schema(self._layer_schema).parquet(f"{self.root}/{layer['path']}").withColumn("_layer", F.lit(n))
            layers = one if layers is None else layers.unionByName(one)
        last = indexing.last_by(layers, "id", ["_layer"]).drop("_layer") if len(manifest["layers"]) > 1 else layers.drop("_layer")
        ids = layers.select("id")
        small = sum(x["rows"] for x in manifest["layers"]) <= self.FEW_IDS
        return base.join(F.broadcast(ids) if small else ids, "id", "left_anti").unionByName(last.filter(~F.col(GONE)).drop(GONE))

    # reading
    @property
    def version(self) -> int:
        return self._manifest()["version"]

    def records(self) -> DataFrame:
        return self._read(self._manifest())

    def count(self) -> int:
        return self.records().count()

    def all_ids(self) -> DataFrame:
        return self.records().select("id")

    def all_documents(self) -> DataFrame:
        return self.records().select("id", F.coalesce("document", F.lit("")).alias("document"))

    def existing_mtimes(self) -> DataFrame:
        return self.records().filter("mtime is not null").select("id", "mtime")

    def embeddings(self, ids: DataFrame) -> DataFrame:
        """Vectors of ids; ids that aren't there are absent."""
        return self.records().join(ids.select("id").distinct(), "id", "left_semi").select("id", "embedding")

    def fetch(self, ids: DataFrame) -> DataFrame:
        return self.records().join(ids.select("id").distinct(), "id", "left_semi")

    # the signature that tells whether vectors can be compared
    @property
    def signature(self) -> tuple | None:
        own = self._manifest()["signature"]
        if own:
            return tuple(own)
        row = self.records().select("model_id", "embed_dim", "granularity").limit(1).collect()
        return tuple(row[0]) if row else None

    # changes
    def _fresh(self, rows: DataFrame) -> DataFrame:
        fresh = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]).filter("id is not null")
        return indexing.last_by(fresh, "id", ["mtime", "caption", "document"]).withColumn(GONE, F.lit(False))

    def _gone(self, ids: DataFrame) -> DataFrame:
        there = self.all_ids().join(ids.select("id").distinct(), "id", "left_semi")
        return there.select(*[(F.col("id") if f.name == "id" else F.lit(None).cast(f.dataType)).alias(f.name) for f in self.schema], F.lit(True).alias(GONE))

    def change(self, rows: DataFrame, gone: DataFrame, signature: tuple | None = None, reset: bool = False) -> bool:
        """Write records and delete ids in one step; ``reset`` drops everything that was there before. What is written isn't deleted."""
        fresh = self._fresh(rows)
        if not reset:
            fresh = fresh.unionByName(self._gone(gone.join(rows.select("id"), "id", "left_anti")))
        return self._commit(fresh, signature, reset)

    def upsert(self, rows: DataFrame, signature: tuple | None = None) -> bool:
        """Write records, replacing those of the same id; of several rows of an id, one is kept. No rows, no change."""
        return self._commit(self._fresh(rows), signature)

    def update_meta(self, rows: DataFrame) -> bool:
        """New values for some columns, the vectors staying; ids that aren't there are ignored."""
        columns = [f.name for f in self.schema if f.name in rows.columns and f.name not in ("id", "embedding")]
        one = indexing.last_by(rows.filter("id is not null").select("id", *columns), "id", columns[:1] or ["id"])
        touched = self.records().join(one.select("id"), "id", "left_semi")
        return self._commit(indexing.update_columns(touched, one, columns).withColumn(GONE, F.lit(False)))

    def delete(self, ids: DataFrame) -> bool:
        return self._commit(self._gone(ids))

    def clear(self) -> bool:
        return self._commit(None, reset=True)

    def vacuum(self) -> None:
        """Delete what the newest manifest doesn't name, and the manifests before it. Call it when nobody reads or writes older versions."""
        now = self._manifest()
        kept = {x["path"] for x in [now["base"], *now["layers"]] if x} | {f"manifest-{now['version']:010d}.json"}
        for status in self._fs.listStatus(self._path(self.root)):
            if status.getPath().getName() not in kept:
                self._fs.delete(status.getPath(), True)
