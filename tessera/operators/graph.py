"""The graph of images and the objects they show, as a table of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges_of(records: DataFrame, image: str | Column = "image_path", classes: str | Column = "classes") -> DataFrame:
    """Distinct (image, class) edges; images without names have none. Null images and null or blank names are left out."""
    image = F.col(image) if isinstance(image, str) else image
    classes = F.col(classes) if isinstance(classes, str) else classes
    rows = records.select(image.alias("image"), classes.alias("classes")).filter("image is not null")
    # the names of a row are made distinct before the shuffle
    return rows.select("image", F.explode(F.array_distinct("classes")).alias("class")).filter("class is not null and trim(class) <> ''").distinct()


def image_count(edges: DataFrame) -> DataFrame:
    return edges.agg(F.countDistinct("image").alias("n_images"))


def class_counts(edges: DataFrame) -> DataFrame:
    """Images of each class; ``edges`` are distinct."""
    return edges.groupBy("class").agg(F.count("*").alias("n"))


def cooccurring(edges: DataFrame, name: str, n: int = 20) -> DataFrame:
    """The ``n`` classes that most images share with class ``name``; ties by name."""
    images = edges.filter(F.col("class") == name).select("image")
    return edges.join(images, "image", "left_semi").filter(F.col("class") != name).groupBy("class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class").limit(n)


def pair_counts(edges: DataFrame) -> DataFrame:
    """Images that show both classes of each pair: (class_a, class_b, n), class_a < class_b.

    The classes of an image come together in one shuffle and their pairs are counted before the second, so
    only counts move; an image has few classes.
    """
    by_image = edges.groupBy("image").agg(F.array_sort(F.collect_list("class")).alias("c"))
    first = by_image.select("c", F.posexplode("c").alias("at", "class_a")).select("class_a", F.explode(F.slice("c", F.col("at") + 2, F.size("c"))).alias("class_b"))
    return first.groupBy("class_a", "class_b").agg(F.count("*").alias("n"))


def top_pairs(edges: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` pairs of classes that most images show; ties by name."""
    return pair_counts(edges).orderBy(F.desc("n"), "class_a", "class_b").limit(n)


def images_with_all(edges: DataFrame, names: list[str]) -> DataFrame:
    """Images that show every class of ``names`` (each counted once); no names give no images."""
    wanted = list(dict.fromkeys(names))
    return edges.filter(F.col("class").isin(wanted)).groupBy("image").agg(F.count("*").alias("n")).filter(F.col("n") == max(1, len(wanted))).select("image")


def images_with_any(edges: DataFrame, names: list[str]) -> DataFrame:
    """Images that show a class of ``names``."""
    return edges.filter(F.col("class").isin(list(names))).select("image").distinct()
