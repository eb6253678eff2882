"""Search entry points: questions in words answered from a store, plainly or by a plan that filters by objects."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.paths import basename, image_id
from tessera.operators import graph, lexical, retrieval
from tessera.operators.store import SnapshotStore
from tessera.plans import planner
from tessera.plans.planner import Answer
from tessera.session import cut_lineage

BLANK = "Enter a search query."
NO_VECTOR = "No stored embedding found — rebuild the index and try again."
SHOWN = ["id", "folder", "image_path", "caption", "member_count", "sidecar_text", "score", "fused", "match", "rank"]
EMPTY = T.StructType([T.StructField(c, t) for c, t in zip(SHOWN, [T.StringType()] * 4 + [T.IntegerType(), T.StringType(), T.DoubleType(), T.DoubleType(), T.StringType(), T.IntegerType()])])


@dataclass
class Search:
    """Answers over one store.

    ``source`` gives the store's records as (id, vector, document, caption, folder, image_path, member_count,
    sidecar_text); ``version`` tells which snapshot they are, so that the keyword index is made again only when
    they changed. ``encode`` makes a vector of a text. ``edges`` is the graph (image key, class), None without one.
    ``chat`` may refine queries, plan and summarise; each falls back to rules if it fails. ``trace`` hears of steps.
    """

    spark: SparkSession
    source: Callable[[], DataFrame]
    version: Callable[[], object]
    encode: Callable[[str], Sequence[float]]
    dim: int
    edges: DataFrame | None = None
    names: Mapping | Sequence | None = None
    mode: str = "hybrid"
    top_k: int = 24
    summaries: bool = True
    chat: object = None
    trace: Callable[[str], None] = lambda step: None
    _kept: tuple | None = field(default=None, repr=False)

    @classmethod
    def over(cls, store: SnapshotStore, embedder, **options) -> "Search":
        """Over a record store and an embedder's texts."""

        def source() -> DataFrame:
            return store.records().select("id", F.col("embedding").alias("vector"), "document", "caption", F.col("leaf_folder").alias("folder"), F.col("representative_image").alias("image_path"), "member_count", "sidecar_text")

        return cls(store.spark, source, lambda: store.version, lambda text: embedder.embed_text([text])[0], embedder.dim, **options)

    # what is kept between questions
    def _snapshot(self) -> tuple[DataFrame, lexical.LexicalIndex]:
        version = self.version()
        if self._kept is None or self._kept[0] != version:
            self.invalidate()
            records = cut_lineage(self.source())
            self._kept = (version, records, lexical.build_index(records, "id", "document", version=version).keep())
        return self._kept[1:]

    def invalidate(self) -> None:
        """Forget the keyword index."""
        if self._kept is not None:
            self._kept[2].drop()
        self._kept = None

    def _question(self, text: str) -> DataFrame:
        vector = [float(x) for x in np.asarray(self.encode(text), dtype=np.float64)]
        return self.spark.createDataFrame([(1, text, vector)], "query_id int, text string, vector array<double>")

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], EMPTY)

    def _hits(self, question: DataFrame, k: int, mode: str) -> DataFrame:
        records, index = self._snapshot()
        if mode == "vector":
            found = retrieval.vector_search(question.select("query_id", "vector"), records, k, self.dim)
        elif mode == "keyword":
            found = retrieval.keyword_search(question, records, index, k)
        else:
            found = retrieval.hybrid_search(question, records, index, k, self.dim)
        return found.select(*SHOWN)

    def search(self, text: str | None, k: int | None = None, mode: str | None = None, refine: bool = True) -> DataFrame:
        """Hits without a summary; none for a blank text. An unknown mode is the vector mode."""
        text = (text or "").strip()
        if not text:
            return self._nothing()
        refined = planner.refine(text, self._model("refine")) if refine else text
        return self._hits(self._question(refined), planner.effective_k(k, self.top_k), planner.effective_mode((mode or self.mode).lower()))

    def query(self, text: str | None, k: int | None = None) -> Answer:
        """Refine, search, summarise."""
        text = (text or "").strip()
        if not text:
            return Answer("", "", self._nothing(), BLANK)
        refined = planner.refine(text, self._model("refine"))
        hits = cut_lineage(self.search(refined, k, refine=False))
        return Answer(text, refined, hits, self._summary(text, hits))

    def similar(self, record_id: str, k: int | None = None) -> Answer:
        """Records like a stored one, by its stored vector; an empty answer with advice if it has none."""
        records, _ = self._snapshot()
        wanted = self.spark.createDataFrame([(record_id,)], "id string")
        named = records.join(F.broadcast(wanted), "id", "left_semi").select(basename(F.coalesce("image_path", "folder"))).head()
        title = f"Similar: {named[0] if named else record_id}"
        found = retrieval.by_example(wanted, records, planner.effective_k(k, self.top_k), self.dim)
        hits = cut_lineage(retrieval._with_hits(found.select("id", "score", F.lit(0.0).alias("fused"), F.lit("vector").alias("match"), "rank"), records).select(*SHOWN))
        return Answer(title, "", hits, "" if hits.take(1) else NO_VECTOR)

    def gallery(self, names: list[str]) -> DataFrame:
        """Records of the images that show all of some classes: score 0, match 'graph'."""
        if self.edges is None:
            return self._nothing()
        shown = graph.images_with_all(self.edges, names).select(F.col("image").alias("id"))
        records, _ = self._snapshot()
        found = records.join(shown, "id", "left_semi").select("id", F.lit(0.0).alias("score"), F.lit(0.0).alias("fused"), F.lit("graph").alias("match"), F.lit(None).cast("int").alias("rank"))
        return retrieval._with_hits(found, records).select(*SHOWN)

    def _ids(self, names: list[str], every: bool) -> DataFrame | None:
        """Records whose image shows the classes; None if the graph is empty or doesn't belong to the store, so that nothing should be filtered by it."""
        if self.edges is None or not self.edges.take(1):
            return None
        images = (graph.images_with_all if every else graph.images_with_any)(self.edges, names).select(F.col("image").alias("id"))
        if not images.take(1):
            return self.spark.createDataFrame([], "id string")
        records, _ = self._snapshot()
        present = cut_lineage(records.select("id").join(images, "id", "left_semi"))
        return present if present.take(1) else None

    def agentic(self, text: str | None, k: int | None = None) -> Answer:
        """Plan, search widely, keep to the objects that the plan requires and excludes, summarise."""
        text = (text or "").strip()
        if not text:
            return Answer("", "", self._nothing(), BLANK)
        k = planner.effective_k(k, self.top_k)
        plan = planner.make_plan(text, self.names, self._model("plan"))
        self.trace(f"plan: {plan.semantic}; required {', '.join(plan.required) or 'none'}; excluded {', '.join(plan.excluded) or 'none'}")
        question = self._question(plan.semantic)
        hits = cut_lineage(self._hits(question, max(3 * k, 30), "hybrid").withColumn("query_id", F.lit(1)))
        self.trace(f"search: {hits.count()} candidates")
        required = self._ids(plan.required, True) if plan.required else None
        if plan.required and required is None:
            self.trace("graph filter: skipped, the graph doesn't match the store")
        excluded = self._ids(plan.excluded, False) if plan.excluded else None
        records, _ = self._snapshot()
        kept = retrieval.filter_by_objects(hits.select("query_id", "id", "score", "fused", "match"), records, question, required, excluded, k, self.dim)
        final = cut_lineage(retrieval._with_hits(kept.select("id", "score", "fused", "match", "rank"), records).select(*SHOWN))
        self.trace(f"filtered: {final.count()} results")
        return Answer(text, plan.semantic, final, self._summary(text, final))

    def _model(self, name: str):
        return getattr(self.chat, name, None)

    def _summary(self, text: str, hits: DataFrame) -> str:
        return planner.summarize(text, [r.asDict() for r in hits.orderBy("rank").collect()], self._model("summarize"), self.summaries)  # at most k rows


def graph_of_records(records: DataFrame, image: str = "image_path", classes: str = "classes") -> DataFrame:
    """Edges between record ids and classes, as the store's ids of images."""
    names = F.transform(classes, lambda x: F.trim(x))
    return graph.edges_of(records, image_id(F.col(image)), names)


def neighbours(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """Ranked hits with the ids before and after them, for paging through a result."""
    w = Window.partitionBy(query).orderBy("rank")
    return hits.withColumn("previous", F.lag("id").over(w)).withColumn("next", F.lead("id").over(w))

