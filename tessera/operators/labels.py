"""Object boxes in label files: parsing, captions and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YOLO_LINE = r"^\d+(?:\s+-?\d*\.?\d+){4,}\s*$"


def is_yolo_text(text: Column) -> Column:
    """Whether a text has a line and all its lines that aren't blank are boxes."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda x: F.trim(x) != "")
    return (F.size(lines) > 0) & F.forall(lines, lambda x: F.trim(x).rlike(YOLO_LINE))


def parse_boxes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Boxes of label texts: (image, seq, cid, cx, cy, w, h).

    A line needs five numbers, more are ignored; lines that don't parse, and class ids that are no finite number, are left out.
    """
    lines = df.select(F.col(id_col).alias("image"), F.posexplode(F.split(F.col(text_col), r"\r\n|\n|\r")).alias("seq", "line"))
    parts = lines.select("image", "seq", F.split(F.trim("line"), r"\s+").alias("p")).filter(F.size("p") >= 5)
    number = [F.expr(f"try_cast(p[{i}] AS double)") for i in range(5)]
    boxes = parts.select("image", "seq", number[0].alias("c"), *[n.alias(a) for n, a in zip(number[1:], ("cx", "cy", "w", "h"))])
    fine = F.col("c").isNotNull() & ~F.isnan("c") & (F.abs("c") < 2147483648.0)
    for a in ("cx", "cy", "w", "h"):
        fine = fine & F.col(a).isNotNull()
    return boxes.filter(fine).select("image", "seq", F.col("c").cast("int").alias("cid"), "cx", "cy", "w", "h")


def named(boxes: DataFrame, class_map: DataFrame) -> DataFrame:
    """Boxes with the display names of their classes; a class without name is '#id'. ``class_map`` has unique ``cid``."""
    names = class_map.select(F.col("cid"), F.col("name").alias("display"))
    return boxes.join(names, "cid", "left").withColumn("name", F.coalesce(F.nullif("display", F.lit("")), F.concat(F.lit("#"), F.col("cid").cast("string")))).drop("display")


def class_histogram(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("cid").agg(F.count("*").alias("n"))


def object_captions(named_boxes: DataFrame, image: str = "image") -> DataFrame:
    """Captions such as ``Objects: car×3, person``: names by count, then by name; ids of the same name count together."""
    counts = named_boxes.groupBy(image, "name").agg(F.count("*").alias("n"))
    listed = counts.groupBy(image).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("name").alias("name")))).alias("l"))
    words = F.transform("l", lambda x: F.when(x["m"] < -1, F.concat(x["name"], F.lit("×"), (-x["m"]).cast("string"))).otherwise(x["name"]))
    return listed.select(image, F.concat(F.lit("Objects: "), F.array_join(words, ", ")).alias("caption"))


def names_in_order(named_boxes: DataFrame, image: str = "image", order: str = "seq") -> DataFrame:
    """The different names of an image in the order of their boxes."""
    first = named_boxes.groupBy(image, "name").agg(F.min(order).alias("at"))
    listed = first.groupBy(image).agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("l"))
    return listed.select(image, F.transform("l", lambda x: x["name"]).alias("names"))


def top_boxes(boxes: DataFrame, per_image: int = 2, per_class: int = 16, most_area: float | None = 0.88, keys: tuple[str, ...] = ("image", "seq")) -> DataFrame:
    """The largest boxes of each class: at most ``per_image`` of an image and ``per_class`` in all; ties by ``keys``."""
    sized = boxes.withColumn("area", F.col("w") * F.col("h"))
    if most_area is not None:
        sized = sized.filter(F.col("area") <= most_area)
    order = [F.desc("area"), *[F.col(k) for k in keys]]
    some = sized.withColumn("r", F.row_number().over(Window.partitionBy("cid", "image").orderBy(*order))).filter(F.col("r") <= per_image).drop("r")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("cid").orderBy(*order))).filter(F.col("rank") <= per_class)


def box_stats(boxes: DataFrame) -> DataFrame:
    """Of each class: boxes, median area, median ratio of width and height (0 where the height isn't positive)."""
    ratio = F.when(F.col("h") > 0, F.col("w") / F.col("h")).otherwise(0.0)
    return boxes.groupBy("cid").agg(F.count("*").alias("n"), F.median(F.col("w") * F.col("h")).alias("median_area"), F.median(ratio).alias("median_ratio"))


def pixel_rect(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column, pad: float = 0.0) -> list[Column]:
    """x1, y1, x2, y2 of a box in pixels, padded by a share of its size and kept inside the image."""
    px, py = w * width * pad, h * height * pad
    return [
        F.greatest(F.lit(0), ((cx - w / 2) * width - px).cast("int")).alias("x1"),
        F.greatest(F.lit(0), ((cy - h / 2) * height - py).cast("int")).alias("y1"),
        F.least(width.cast("int"), ((cx + w / 2) * width + px).cast("int")).alias("x2"),
        F.least(height.cast("int"), ((cy + h / 2) * height + py).cast("int")).alias("y2"),
    ]


def class_hue(cid: Column) -> Column:
    return F.pmod(cid * 57, F.lit(360))


def class_list(ids: DataFrame, names: DataFrame) -> DataFrame:
    """Found and named class ids together, numbers first and in order: (cid, n, name, pos)."""
    both = ids.select("cid", "n").join(names.select("cid", "name"), "cid", "full_outer").select("cid", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("name", F.lit("")).alias("name"))
    digits = F.col("cid").cast("string").rlike(r"^\d+$")
    return both.orderBy((~digits).cast("int"), F.expr("try_cast(cid AS bigint)"), F.col("cid").cast("string"))


def label_file_split(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """How many text files are label files, how many aren't, how many are empty."""
    blank = F.trim(F.coalesce(text_col, F.lit(""))) == ""
    yolo = is_yolo_text(F.col(text_col))
    return texts.agg(F.count_if(yolo).alias("labels"), F.count_if(~yolo & ~blank).alias("texts"), F.count_if(blank).alias("empty"))
