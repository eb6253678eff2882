"""Queries that go through the search entry points, the record store and image trees, with SQL for each."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import catalog as C
from tessera.catalog import CURRENT, DIM, EDGES, HITS, SNAPSHOTS, clean_edges, hybrid_sql, query, six, table
from tessera.functions import embedding as E
from tessera.functions import paths as P
from tessera.functions import text as X
from tessera.operators import history
from tessera.operators.store import SnapshotStore
from tessera.plans import planner
from tessera.plans.build import IndexSettings, build_index, graph_edges, refresh_captions
from tessera.plans.search import Search, neighbours
from tessera.session import shared_folder
from tessera.sources import files, pictures


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


# search entry points; the vector of any text is the first axis, so that SQL knows it

QUESTION = "doorway and shadow without pavement"
NAMES = ["doorway", "shadow", "pavement", "rainbow"]
ASKED = f"asked AS (SELECT 1 AS query_id, '{planner.expand(QUESTION)}' AS text, list_transform(range(64), lambda i: CASE WHEN i = 0 THEN 1.0 ELSE 0.0 END) AS v)"


def asked_sql(k: int) -> str:
    return hybrid_sql(k).replace(C.QUERYSET, ASKED)


def service(spark, d, **options) -> Search:
    axis = np.zeros(DIM)
    axis[0] = 1.0
    edges = clean_edges(spark, d).select(P.image_id(F.col("image")).alias("image"), "class")
    return Search(spark, lambda: C.store_hits(spark, d), lambda: 1, lambda text: axis, DIM, edges=edges, names=NAMES, **options)


@query(asked_sql(24) + " SELECT id, rank, round(fused, 6) AS fused, match, score FROM shown")
def service_query(spark, d):
    """A question in words, answered in the store's usual mode."""
    hits = service(spark, d).query(QUESTION).hits
    return hits.select("id", F.col("rank").cast("int").alias("rank"), six(F.col("fused")).alias("fused"), "match", six(F.col("score")).alias("score"))


@query(asked_sql(72) + rf""", {EDGES},
req AS (SELECT image FROM edges WHERE class IN ('doorway', 'shadow') GROUP BY 1 HAVING count(*) = 2), exc AS (SELECT image FROM edges WHERE class = 'pavement'),
ids AS (SELECT id, lower(replace(representative_image, '\', '/')) AS image FROM cur), reqids AS (SELECT id FROM ids WHERE image IN (SELECT image FROM req)), excids AS (SELECT id FROM ids WHERE image IN (SELECT image FROM exc)),
kept AS (SELECT id, score, fused, match FROM shown WHERE id IN (SELECT id FROM reqids)),
pool AS (SELECT id, s FROM sims WHERE id IN (SELECT id FROM reqids) AND id NOT IN (SELECT id FROM excids) ORDER BY s DESC, id LIMIT 24),
more AS (SELECT id, round(greatest(s, 0), 6) AS score, 0.0 AS fused, 'graph' AS match FROM pool WHERE id NOT IN (SELECT id FROM kept)),
both_ AS (SELECT * FROM kept UNION ALL SELECT * FROM more), marked AS (SELECT *, max(CASE WHEN match = 'graph' THEN 1 ELSE 0 END) OVER () AS added FROM both_)
SELECT id, score, match, row_number() OVER (ORDER BY CASE WHEN added = 1 THEN score ELSE fused END DESC, id)::INT AS rank FROM marked WHERE id NOT IN (SELECT id FROM excids) QUALIFY rank <= 24""")
def agentic_run(spark, d):
    """The same question by a plan: images with a doorway and a shadow and without pavement."""
    hits = service(spark, d).agentic(QUESTION).hits
    return hits.select("id", six(F.col("score")).alias("score"), "match", F.col("rank").cast("int").alias("rank"))


@query(f"""WITH {CURRENT}, u AS (SELECT id, embedding::DOUBLE[] AS v FROM (SELECT id, embedding, embedding AS v FROM cur) WHERE {C.USABLE}), q AS (SELECT * FROM u WHERE id = (SELECT min(id) FROM u)),
s AS (SELECT u.id, round(list_cosine_similarity(q.v, u.v), 12) AS s FROM q, u WHERE u.id <> q.id ORDER BY s DESC, u.id LIMIT 24) SELECT id, round(greatest(s, 0), 6) AS score, row_number() OVER (ORDER BY s DESC, id)::INT AS rank FROM s""")
def similar_records(spark, d):
    """Records like the first one that has a usable vector."""
    from tessera.functions.vector import is_usable

    search = service(spark, d)
    first = C.store_hits(spark, d).filter(is_usable(F.col("vector"), DIM)).agg(F.min("id")).head()[0]
    return search.similar(first).hits.select("id", six(F.greatest("score", F.lit(0.0))).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(rf"""WITH {CURRENT}, {EDGES}, m AS (SELECT image FROM edges WHERE class IN ('doorway', 'shadow') GROUP BY 1 HAVING count(*) = 2)
SELECT id, representative_image AS image_path, coalesce(nullif(caption, ''), document, '') AS caption, match FROM (SELECT *, 'graph' AS match FROM cur) WHERE lower(replace(representative_image, '\', '/')) IN (SELECT image FROM m)""")
def service_gallery(spark, d):
    """Records of the images that show a doorway and a shadow."""
    return service(spark, d).gallery(["doorway", "shadow"]).select("id", "image_path", "caption", "match")


@query("WITH h AS (SELECT DISTINCT hit_id, query_id, fused_score FROM folder_hits), r AS (SELECT query_id, hit_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, hit_id) AS rank FROM h) SELECT *, lag(id) OVER w AS previous, lead(id) OVER w AS next FROM r WINDOW w AS (PARTITION BY query_id ORDER BY rank)")
def viewer_neighbours(spark, d):
    """Hits with those before and after them."""
    from pyspark.sql import Window

    hits = table(spark, d, "folder_hits").select("hit_id", "query_id", "fused_score").distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), "hit_id")
    return neighbours(hits.select("query_id", F.col("hit_id").alias("id"), F.row_number().over(w).cast("long").alias("rank")))


# planner functions over columns

_NEGATED = "CASE WHEN regexp_matches(substr(caption, at_ + length(name), 6), '없는|없이|제외|말고|빼고|아닌') THEN true ELSE regexp_matches(lower(substr(caption, greatest(1, at_ - 14), at_ - greatest(1, at_ - 14))), 'without|no |not |except|excluding|minus') END"
_MENTIONED = [("umbrella",), ("crane",), ("ladder",), ("mirror",), ("우산",), ("사다리",)]


@query(f"WITH n AS (SELECT unnest({[x for x, in _MENTIONED]}) AS name), h AS (SELECT DISTINCT hit_id, caption FROM folder_hits WHERE caption IS NOT NULL), m AS (SELECT *, instr(caption, name) AS at_ FROM h, n) SELECT hit_id, name, {_NEGATED} AS negated FROM m WHERE at_ > 0")
def negations(spark, d):
    """Captions that name one of six things, and whether they negate it."""
    names = F.explode(F.array(*[F.lit(n) for n, in _MENTIONED]))
    rows = table(spark, d, "folder_hits").filter("caption is not null").select("hit_id", "caption").distinct().select("*", names.alias("name"))
    return rows.select("hit_id", "name", X.negated(F.col("caption"), F.col("name")).alias("negated")).filter("negated is not null")


@F.pandas_udf(T.StringType())
def _planned(captions: pd.Series) -> pd.Series:
    def one(text):
        plan = planner.rule_plan(text, [n for n, in _MENTIONED])
        return "|".join([*sorted(plan.required), "-", *sorted(plan.excluded)])

    return captions.map(one)


@query(f"""WITH n AS (SELECT unnest({[x for x, in _MENTIONED]}) AS name), h AS (SELECT DISTINCT hit_id, caption FROM folder_hits WHERE caption IS NOT NULL), m AS (SELECT *, instr(caption, name) AS at_ FROM h, n),
g AS (SELECT hit_id, caption, name, {_NEGATED} AS neg FROM m WHERE at_ > 0)
SELECT h.hit_id, array_to_string(list_concat(list_concat(coalesce(list(name ORDER BY name) FILTER (NOT neg), []), ['-']), coalesce(list(name ORDER BY name) FILTER (neg), [])), '|') AS plan FROM h LEFT JOIN g ON g.hit_id = h.hit_id AND g.caption = h.caption GROUP BY h.hit_id, h.caption""")
def rule_plans(spark, d):
    """Captions as queries: the objects that their plans require and exclude."""
    rows = table(spark, d, "folder_hits").filter("caption is not null").select("hit_id", "caption").distinct()
    return rows.select("hit_id", _planned("caption").alias("plan"))


# the record store: the snapshots of the catalogue, written and changed


def _store(spark, d) -> tuple[SnapshotStore, DataFrame, DataFrame]:
    old, new = C.snapshots(spark, d)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "caption", "document", "mtime")])
    store = SnapshotStore(spark, scratch(spark, "store"), schema)
    store.upsert(old)
    return store, old, new


@query(f"WITH {SNAPSHOTS} SELECT * FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new")
def store_upsert(spark, d):
    store, _, new = _store(spark, d)
    store.upsert(new)
    return store.records()


@query(f"WITH {SNAPSHOTS} SELECT old.id, coalesce(new.caption, old.caption) AS caption, coalesce(new.document, old.document) AS document, old.mtime FROM old LEFT JOIN new ON new.id = old.id")
def store_update_meta(spark, d):
    store, _, new = _store(spark, d)
    store.update_meta(new.select("id", "caption", "document"))
    return store.records()


@query(f"WITH {SNAPSHOTS} SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)")
def store_delete(spark, d):
    store, _, new = _store(spark, d)
    store.delete(new.select("id"))
    return store.records()


@query(f"WITH {SNAPSHOTS} SELECT old.id, old.mtime, coalesce(document, '') AS document FROM old WHERE mtime IS NOT NULL")
def store_scan(spark, d):
    """Change keys and documents of a store."""
    store, _, _ = _store(spark, d)
    return store.existing_mtimes().join(store.all_documents(), "id")


@query(f"WITH {SNAPSHOTS} SELECT (SELECT count(*) FROM old) AS n, (SELECT count(*) FROM old SEMI JOIN new USING (id)) AS fetched, 0::BIGINT AS cleared, 2::BIGINT AS version")
def store_states(spark, d):
    """A store's count, how many records a batch of ids fetches, and what is left after clearing it."""
    store, _, new = _store(spark, d)
    n, fetched = store.count(), store.fetch(new).count()
    store.clear()
    return spark.createDataFrame([(n, fetched, store.count(), store.version)], "n long, fetched long, cleared long, version long")


# an image tree made of the evaluation items: a folder for each suite, an image for each item


def _write(spark, root: str, contents: dict[str, bytes]) -> None:
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, data in contents.items():
        stream = fs.create(jvm.org.apache.hadoop.fs.Path(f"{root}/{name}"), True)
        stream.write(bytearray(data))
        stream.close()


CLASSES = 7


def tree(spark, d) -> str:
    """Grey images whose brightness is the item's id modulo 256; label files for one suite, JSON for another, plain text for the third."""
    out: dict[str, bytes] = {}
    for r in table(spark, d, "eval_items").select("item_id", "suite", "text").collect():  # a fixed table of 240 rows
        at, c = f"{r['suite']}/{r['item_id']}", r["item_id"] % CLASSES
        image = np.full((32, 64, 3), r["item_id"] % 256, np.uint8)
        if r["suite"] == "label_judge":
            image = np.broadcast_to((np.arange(64) * 3).astype(np.uint8)[None, :, None], image.shape)
            out[f"{at}.txt"] = f"{c} 0.5 0.5 0.2 0.2\n{c + 1} 0.5 0.5 0.4 0.4\n{c} 0.1 0.1 0.1 0.1 0.9".encode()
        elif r["suite"] == "caption_qa":
            out[f"{at}.json"] = json.dumps({"n": 1, "caption": r["text"]}).encode()
        else:
            out[f"{at}.txt"] = r["text"].encode()
        out[f"{at}.bmp"] = E.write_bmp(image)
    root = scratch(spark, "tree")
    _write(spark, root, out)
    return root


def _item(path: str = "path"):
    return F.expr(f"cast(regexp_extract({path}, '([0-9]+)[.][a-z]+$', 1) as long)")


@query("SELECT suite, count(*) AS n_images FROM eval_items GROUP BY 1")
def tree_folders(spark, d):
    """Leaf folders of a tree and their images."""
    found = files.images(files.scan_files(spark, tree(spark, d)))
    return files.leaf_folders(found).select(P.basename(F.col("folder")).alias("suite"), "n_images")


@query("SELECT item_id, CASE WHEN suite = 'label_judge' THEN '' ELSE text END AS sidecar FROM eval_items")
def tree_sidecars(spark, d):
    """Images with what their sidecars say; label files say nothing."""
    root = tree(spark, d)
    found = files.with_sidecar(files.images(files.scan_files(spark, root)), files.sidecar_texts(files.texts(spark, root)))
    return found.select(_item().alias("item_id"), "sidecar")


@query(f"SELECT item_id, CASE WHEN suite = 'label_judge' THEN 3 ELSE 0 END AS boxes, CASE WHEN suite = 'label_judge' THEN item_id % {CLASSES} END::INT AS first_class FROM eval_items")
def tree_labels(spark, d):
    """Images with the boxes of their label files; other texts are no boxes."""
    from tessera.operators import labels

    root = tree(spark, d)
    found = files.labels(files.images(files.scan_files(spark, root)), files.texts(spark, root))
    is_label = labels.is_yolo_text(F.col("label_text"))
    boxes = labels.parse_boxes(found.filter(is_label), "path", "label_text").groupBy("image").agg(F.count("*").cast("int").alias("boxes"), F.min_by("cid", "seq").alias("first_class"))
    return found.join(boxes, found["path"] == boxes["image"], "left").select(_item().alias("item_id"), F.coalesce("boxes", F.lit(0)).alias("boxes"), "first_class")


@query("SELECT item_id, CASE WHEN suite <> 'label_judge' THEN item_id % 256 ELSE 94.5 END::DOUBLE AS brightness, CASE WHEN suite = 'label_judge' THEN -1 ELSE 0 END::BIGINT AS bits FROM eval_items")
def tree_pictures(spark, d):
    """Brightness and difference hash of images: grey ones, and ones that get brighter to the right."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.bmp").load(tree(spark, d))
    return rows.select(_item().alias("item_id"), F.round(E.mean_brightness("content"), 3).alias("brightness"), E.image_dhash("content").alias("bits"))


@query("SELECT item_id, true AS made FROM eval_items")
def tree_thumbnails(spark, d):
    made = pictures.thumbnails(spark, tree(spark, d), "*.bmp", 8)
    return made.select(_item().alias("item_id"), F.col("picture").isNotNull().alias("made"))


_CAPTION = f"CASE WHEN suite = 'label_judge' THEN 'Objects: {{p}}' || item_id % {CLASSES} || '×2, {{p}}' || (item_id % {CLASSES} + 1) ELSE text END"


def _names(prefix: str) -> dict[str, str]:
    return {str(c): f"{prefix}{c}" for c in range(CLASSES + 1)}


@query(f"SELECT item_id, suite, {_CAPTION.format(p='thing')} AS caption, {_CAPTION.format(p='thing')} AS document, 1 AS member_count, 32 AS embed_dim, true AS embedded FROM eval_items")
def tree_index(spark, d):
    """Records of a build over a tree."""
    store = SnapshotStore(spark, scratch(spark, "index"))
    build_index(spark, tree(spark, d), store, E.HashEmbedder(32), IndexSettings(class_names=_names("thing")))
    return store.records().select(_item("representative_image").alias("item_id"), P.basename(F.col("leaf_folder")).alias("suite"), "caption", "document", "member_count", "embed_dim", (F.size("embedding") == 32).alias("embedded"))


@query("SELECT * FROM (VALUES (240::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 240::BIGINT), (0, 240, 0, 0, 240)) t(written, skipped, pruned, failed, total)")
def tree_builds(spark, d):
    """Reports of a first build and of a second one, which has nothing to do."""
    store, root = SnapshotStore(spark, scratch(spark, "index")), tree(spark, d)
    reports = [build_index(spark, root, store, E.HashEmbedder(16), IndexSettings(class_names=_names("thing")))[0].head() for _ in range(2)]
    return spark.createDataFrame([tuple(r) for r in reports], "written long, skipped long, pruned long, failed long, total long")


@query(f"SELECT item_id, {_CAPTION.format(p='object')} AS caption FROM eval_items")
def tree_refresh(spark, d):
    """Captions after new class names, without embedding again."""
    store, root = SnapshotStore(spark, scratch(spark, "index")), tree(spark, d)
    build_index(spark, root, store, E.HashEmbedder(16), IndexSettings(class_names=_names("thing")))
    refresh_captions(spark, root, store, _names("object"))
    return store.records().select(_item("representative_image").alias("item_id"), "caption")


@query(f"SELECT item_id, 'thing' || (item_id % {CLASSES} + k) AS class FROM eval_items, range(2) t(k) WHERE suite = 'label_judge'")
def tree_edges(spark, d):
    """Edges of the graph of a tree."""
    return graph_edges(spark, tree(spark, d), _names("thing")).select(_item("image").alias("item_id"), "class")


# texts about results


@query(f"""WITH {HITS}, s AS (SELECT hit_id, query_id, min(score) AS score FROM folder_hits GROUP BY 1, 2) SELECT r.query_id, rank::INT AS rank,
'Result ' || rank || '/' || n || ' · ' || CASE WHEN isnan(score) THEN 'NaN' ELSE printf('%.2f', score) END || ' · ' || coalesce(caption, '') AS label FROM r JOIN s ON s.hit_id = r.hit_id AND s.query_id = r.query_id""")
def rank_labels(spark, d):
    """Labels of the hits of each query."""
    scores = table(spark, d, "folder_hits").groupBy("hit_id", "query_id").agg(F.min("score").alias("score"))
    hits = C.ranked_hits(spark, d).join(scores, ["hit_id", "query_id"])
    return history.rank_labels(hits, "query_id", C._order()).select("query_id", F.col("rank").cast("int").alias("rank"), "label")


@query(f"""WITH {HITS} SELECT query_id, 'Found ' || max(n) || ' matching folders for ''' || query_id || '''. Most similar: ' || string_agg(regexp_extract(replace(folder, '\\', '/'), '([^/]*)/*$', 1), ', ' ORDER BY rank) FILTER (rank <= 3)
 || '. Top caption: ' || coalesce(max(caption) FILTER (rank = 1), '') AS summary FROM r GROUP BY 1""")
def summary_template(spark, d):
    """A sentence on the results of each query."""
    return history.summaries(C.ranked_hits(spark, d), "query_id", C._order())
