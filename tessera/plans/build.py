"""Building and refreshing an index of an image tree."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions.embedding import Embedder, embed_images
from tessera.operators import indexing, labels, representative
from tessera.operators.graph import edges_of
from tessera.operators.store import SnapshotStore
from tessera.session import cut_lineage
from tessera.sources import files


@dataclass
class IndexSettings:
    """``granularity`` is 'image' or 'folder'; ``class_names`` are the display names of class ids."""

    granularity: str = "image"
    class_names: dict[str, str] = field(default_factory=dict)
    model_id: str = "hash"
    max_members: int = 64
    full: bool = False


def label_captions(spark: SparkSession, found: DataFrame, text_files: DataFrame, names: dict[str, str]) -> DataFrame:
    """Captions from object labels: (path, caption)."""
    boxes = labels.parse_boxes(files.labels(found, text_files).filter("label_text is not null"), "path", "label_text")
    return labels.object_captions(labels.named(boxes, files.class_table(spark, names))).withColumnRenamed("image", "path")


def graph_edges(spark: SparkSession, root: str, names: dict[str, str]) -> DataFrame:
    """Edges between images and the classes of their labels."""
    found, text_files = files.images(files.scan_files(spark, root)), files.texts(spark, root)
    boxes = labels.parse_boxes(files.labels(found, text_files).filter("label_text is not null"), "path", "label_text")
    listed = labels.names_in_order(labels.named(boxes, files.class_table(spark, names)))
    return edges_of(listed.withColumnRenamed("names", "classes"), "image")


def units(spark: SparkSession, root: str, settings: IndexSettings) -> DataFrame:
    """What is to be indexed: (id, path, leaf_folder, member_count, rep_method, caption, sidecar_text, document, mtime)."""
    scanned = files.scan_files(spark, root)
    found, text_files = files.images(scanned), files.texts(spark, root)
    sidecars = files.sidecar_texts(text_files)
    with_text = files.with_sidecar(found, sidecars)
    captions = label_captions(spark, found, text_files, settings.class_names)
    if settings.granularity == "image":
        label = files.labels(found, text_files).select("path", "label_seconds")
        rows = with_text.join(captions, "path", "left").join(label, "path", "left")
        caption = F.coalesce(F.nullif("caption", F.lit("")), F.col("sidecar"))
        return rows.select(
            P.image_id(F.col("path")).alias("id"), "path", F.col("folder").alias("leaf_folder"), F.lit(1).alias("member_count"), F.lit("image").alias("rep_method"), caption.alias("caption"), F.lit("").alias("sidecar_text"),
            P.image_document(caption, F.col("path")).alias("document"), P.composite_key(P.change_key(F.col("seconds")), F.when(F.col("label_seconds").isNotNull(), P.change_key(F.col("label_seconds")))).alias("mtime"),
        )
    chosen = representative.representatives(found.withColumn("lower", F.lower("path")), "folder", "path", ["lower", "path"], cap=settings.max_members)
    newest = scanned.groupBy(P.parent(F.col("path")).alias("folder")).agg(F.max("seconds").alias("seconds"), F.count("*").alias("n"))
    said = files.folder_texts(with_text, sidecars)
    rows = chosen.join(newest, "folder").join(said, "folder", "left").join(captions, "path", "left")
    text = F.coalesce("sidecar_text", F.lit(""))
    # the newest file and the number of files stand for the folder's own time, which object stores don't have
    return rows.select(
        P.folder_id(F.col("folder")).alias("id"), "path", F.col("folder").alias("leaf_folder"), "member_count", F.col("method").alias("rep_method"), F.coalesce("caption", F.lit("")).alias("caption"), F.left(text, F.lit(400)).alias("sidecar_text"),
        P.folder_document(F.col("caption"), text, F.col("folder")).alias("document"), F.concat_ws("|", P.change_key(F.col("seconds")), F.col("n").cast("string")).alias("mtime"),
    )


def build_index(spark: SparkSession, root: str, store: SnapshotStore, embedder: Embedder, settings: IndexSettings | None = None) -> tuple[DataFrame, DataFrame]:
    """Bring a store up to date with an image tree: embeds what is new or changed, deletes what is gone.

    Returns the report (one row) and the records that couldn't be embedded (id, error). Another model, dimension or
    granularity than the store's makes all records new.
    """
    settings = settings or IndexSettings(model_id=embedder.name)
    signature = (settings.model_id, embedder.dim, settings.granularity)
    reset = settings.full or (store.signature is not None and store.signature != signature)
    wanted = cut_lineage(units(spark, root, settings))
    stored = store.records().filter(F.lit(not reset)).select("id", F.col("mtime").alias("change_key"))
    status = cut_lineage(indexing.classify(wanted.select("id", F.col("mtime").alias("change_key")), stored))
    todo = wanted.join(status.filter("status in ('new', 'changed')").select("id"), "id", "left_semi")
    embedded = cut_lineage(embed_images(todo, embedder))
    good, bad = indexing.split_usable(embedded, "embedding")
    rows = good.withColumnRenamed("path", "representative_image").withColumns({"model_id": F.lit(settings.model_id), "embed_dim": F.lit(embedder.dim), "granularity": F.lit(settings.granularity)})
    store.change(rows, status.filter("status = 'gone'").select("id"), signature, reset)
    return indexing.build_report(status, bad), bad


def refresh_captions(spark: SparkSession, root: str, store: SnapshotStore, names: dict[str, str]) -> int:
    """New captions from labels under new class names, without embedding again; for image granularity. Returns how many records have one."""
    if store.signature and store.signature[2] != "image":
        return 0
    found, text_files = files.images(files.scan_files(spark, root)), files.texts(spark, root)
    captions = label_captions(spark, found, text_files, names).select(P.image_id(F.col("path")).alias("id"), "caption", P.image_document(F.col("caption"), F.col("path")).alias("document"))
    mine = cut_lineage(captions.filter("caption <> ''").join(store.all_ids(), "id", "left_semi"))
    n = mine.count()
    if n:
        store.update_meta(mine)
    return n
