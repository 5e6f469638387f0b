"""Detected strings as rows, and the filters that decide which of them can identify a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbstone.functions import text as t
from kerbstone.functions.geometry import from_grid, from_pixels, from_polygon

#: Classes that leave the scene or show changing text, other names for classes, and what
#: open-vocabulary segmenters are asked for besides.
DYNAMIC_CLASSES = ("person", "bicycle", "car", "motorcycle", "bus", "truck", "train", "backpack", "handbag", "suitcase", "tv", "laptop", "cell phone")
CLASS_ALIASES = {
    "motorbike": "motorcycle", "aeroplane": "airplane", "tvmonitor": "tv", "tv monitor": "tv", "sofa": "couch", "pottedplant": "potted plant",
    "diningtable": "dining table", "mobile phone": "cell phone", "monitor": "tv", "screen": "tv",
}
#: Detector classes dropped from graphs as moving or movable.
DETECTOR_DYNAMIC = (
    "airplane", "apple", "backpack", "banana", "baseball bat", "baseball glove", "bear", "bicycle", "bird", "boat", "book", "bottle", "bowl", "broccoli",
    "bus", "cake", "car", "carrot", "cat", "cell phone", "clock", "cow", "cup", "dog", "donut", "elephant", "fork", "frisbee", "giraffe", "hair drier",
    "handbag", "horse", "hot dog", "keyboard", "kite", "knife", "laptop", "motorcycle", "mouse", "orange", "person", "pizza", "remote", "sandwich",
    "scissors", "sheep", "skateboard", "skis", "snowboard", "spoon", "sports ball", "suitcase", "surfboard", "teddy bear", "tennis racket", "tie",
    "toothbrush", "train", "truck", "tv", "umbrella", "vase", "wine glass", "zebra",
)
OPEN_PROMPTS = ("monitor", "information display", "screen")


def detection_rows(frame_texts: DataFrame) -> DataFrame:
    """``ann_id, frame_id, sequence, det_pos, box, text, confidence, dynamic_score``; each annotation once.

    Rows of a null ann_id are left out; of deliveries that differ the latest counts.
    """
    latest = frame_texts.where("ann_id IS NOT NULL").groupBy("ann_id").agg(F.max_by(F.struct("frame_id", "sequence", "detections"), F.struct("written_at", F.xxhash64("detections"))).alias("r"))
    rows = latest.select("ann_id", "r.frame_id", "r.sequence", F.posexplode("r.detections").alias("det_pos", "d"))
    return rows.where("d IS NOT NULL").select("ann_id", "frame_id", "sequence", "det_pos", "d.box", "d.text", "d.confidence", "d.dynamic_score")


def drop_junk(rows: DataFrame, min_length: int = 3, drop_numeric: bool = True) -> DataFrame:
    """Off when no length is asked for and digits may stay."""
    return rows if min_length <= 0 and not drop_numeric else rows.where(~t.is_junk(F.col("text"), min_length, drop_numeric))


def drop_dynamic(rows: DataFrame, threshold: float | None = 0.5, strict: bool = True) -> DataFrame:
    """Keeps scores strictly below the threshold; None turns the filter off.

    A null score means no segmenter ran: with ``strict`` the query fails on it, otherwise the row goes.
    """
    if threshold is None:
        return rows
    score = F.col("dynamic_score")
    if strict:
        score = F.coalesce(score, F.raise_error(F.concat(F.lit("no dynamic score for a string of annotation "), F.col("ann_id").cast("string"))).cast("double"))
    return rows.where(score < threshold)


def retained(rows: DataFrame, min_length: int = 3, drop_numeric: bool = True, threshold: float | None = 0.5, strict: bool = True, use_text: bool = True) -> DataFrame:
    """Junk goes first, so a junk string without a score is no error."""
    if not use_text:
        return rows.where(F.lit(False))
    return drop_dynamic(drop_junk(rows, min_length, drop_numeric), threshold, strict)


def annotation_filter(rows: DataFrame, min_length: int = 3, threshold: float = 0.5) -> DataFrame:
    """The filter at annotation time: here a string without a score passes."""
    return drop_junk(rows, min_length).where(F.col("dynamic_score").isNull() | (F.col("dynamic_score") < threshold))


def keep_flagged(detections: Column, flags: Column) -> Column:
    """The detections whose flag is true; the query fails when the lengths differ."""
    same = F.size(detections) == F.size(flags)
    pairs = F.zip_with(detections, flags, lambda d, f: F.struct(d.alias("d"), f.alias("f")))
    kept = F.transform(F.filter(pairs, lambda z: F.coalesce(z.getField("f"), F.lit(False))), lambda z: z.getField("d"))
    return F.when(same, kept).otherwise(F.raise_error(F.lit("flags and detections differ in number")))


def canonical_class(label: Column) -> Column:
    """A detector's label as a known class name."""
    name = F.lower(t.strip(label))
    aliases = F.create_map(*[F.lit(x) for pair in CLASS_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, name), name)


def is_dynamic(label: Column, classes: tuple[str, ...] = DYNAMIC_CLASSES) -> Column:
    return F.coalesce(canonical_class(label).isin(*classes), F.lit(False))


def drop_detections(objects: DataFrame, min_area: float = 0.001, keep_dynamic: bool = False) -> DataFrame:
    """Detector output (label, x1, y1, x2, y2) without boxes under ``min_area`` and, by default, dynamic labels."""
    kept = objects.where((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) >= min_area)
    return kept if keep_dynamic else kept.where(~F.lower("label").isin(*DETECTOR_DYNAMIC))


def shuffled_texts(rows: DataFrame, seed: int = 0) -> DataFrame:
    """The same detections with all strings dealt anew over the whole corpus: a control.

    Strings are ranked by a seeded digest, places by their key; equal ranks meet. Ranks come from sums over
    even ranges of the digest, so no task sorts the corpus.
    """
    places = _ranked(rows, F.md5(F.concat_ws("|", F.lit("place"), "ann_id", "det_pos")))
    deal = _ranked(rows.select("ann_id", "det_pos", F.col("text").alias("dealt")), F.md5(F.concat_ws("|", F.lit(str(seed)), "ann_id", "det_pos"))).select("rank", "dealt")
    return places.join(deal, "rank").drop("rank", "text").withColumnRenamed("dealt", "text")


def ngram_vectors(rows: DataFrame, key: str, text: str, dim: int = 256, sizes: tuple[int, int] = (3, 5), lowercase: bool = True) -> DataFrame:
    """``key, bucket, weight``: counts of the n-gram buckets of each text, scaled to unit length.

    Only filled buckets have rows, so a blank or null text has none.
    """
    counted = rows.select(key, F.explode(t.ngram_buckets(F.col(text), dim, sizes, lowercase)).alias("bucket")).groupBy(key, "bucket").agg(F.count("*").cast("double").alias("n"))
    norms = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counted.select(key, "bucket", (F.col("n") / norms).alias("weight"))


def _ranked(rows: DataFrame, digest: Column, digits: int = 3) -> DataFrame:
    """Adds ``rank``, the global position by a uniform hex digest (ties by key)."""
    keyed = rows.withColumn("_key", digest).withColumn("_range", F.substring("_key", 1, digits))
    counts = keyed.groupBy("_range").agg(F.count("*").alias("_n"))
    # at most 16 ** digits rows
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_key", "ann_id", "det_pos"))
    return keyed.withColumn("_at", within).join(offsets, "_range").withColumn("rank", F.col("_offset") + F.col("_at")).drop("_key", "_range", "_offset", "_at")


def word_answers(answers: DataFrame) -> DataFrame:
    """``key, pos, x, y, w, h, text, error`` of recognizer answers (key, answer, width, height) on a 0..1000 grid.

    Items that aren't words are skipped; an answer that is no array, has a coordinate beyond the grid, or
    has items but no valid one, gives one row with its ``error``. Null answers are errors too.
    """
    parsed = answers.withColumn("_items", t.answer_array(F.col("answer")))
    empty = F.coalesce(t.strip(F.col("answer")).rlike(r"(?i)^(?:```(?:json)?\s*)?\[\s*\](?:\s*```)?$"), F.lit(False))
    items = parsed.select("key", "width", "height", F.posexplode_outer("_items").alias("pos", "v"), F.when(F.col("_items").isNull(), "no array of words").when((F.size("_items") == 0) & ~empty, "an empty array beside other output").alias("_broken"))
    box = F.coalesce(*[t.answer_box(F.col("v"), f"$.{n}") for n in ("bbox", "box", "bbox_2d")])
    word = F.coalesce(*[F.when(F.schema_of_variant(F.try_variant_get("v", f"$.{n}", "variant")) == "STRING", F.try_variant_get("v", f"$.{n}", "string")) for n in ("text", "label")])
    known = items.withColumn("_b", F.when(word.isNotNull(), box)).withColumn("text", t.strip(word))
    outside = F.coalesce(F.exists("_b", lambda x: (x < 0) | (x > 1000)), F.lit(False))
    at = lambda i, size: from_grid(F.get("_b", F.lit(i)), F.col(size))
    placed = known.withColumn("_out", outside).withColumn("x", at(0, "width")).withColumn("y", at(1, "height")).withColumn("w", at(2, "width") - F.col("x")).withColumn("h", at(3, "height") - F.col("y"))
    placed = placed.withColumn("_ok", F.coalesce((F.col("w") > 0) & (F.col("h") > 0) & (F.col("text") != ""), F.lit(False)))
    whole = Window.partitionBy("key")
    error = F.when(F.col("_broken").isNotNull(), F.col("_broken")).when(F.bool_or("_out").over(whole), "coordinates beyond the grid").when(~F.bool_or("_ok").over(whole) & F.col("pos").isNotNull(), "no valid box and text")
    judged = placed.withColumn("error", error)
    good = judged.where("error IS NULL AND _ok").select("key", "pos", "x", "y", "w", "h", "text", "error")
    none = lambda kind: F.lit(None).cast(kind)
    bad = judged.where("error IS NOT NULL").select("key", none("int").alias("pos"), none("double").alias("x"), none("double").alias("y"), none("double").alias("w"), none("double").alias("h"), none("string").alias("text"), "error").distinct()
    return good.unionByName(bad)


def predictions_to_detections(rows: DataFrame) -> DataFrame:
    """Normalized boxes from pixel predictions (key, pos, bbox or polygon, text, confidence, width, height).

    ``bbox`` is [x, y, w, h], ``polygon`` an array of points used where there is no bbox. ``box`` and ``score``, where there
    are such columns, stand in for an absent bbox and confidence. Readings that mean
    no text, and boxes without area after clipping, are dropped; a null confidence counts as 1.
    """
    for name, other in (("bbox", "box"), ("confidence", "score")):
        if other in rows.columns:
            rows = rows.withColumn(name, F.coalesce(name, other) if name in rows.columns else F.col(other))
    if "confidence" not in rows.columns:
        rows = rows.withColumn("confidence", F.lit(None).cast("double"))
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    part = lambda i: F.get("bbox", F.lit(i))
    a, b = from_pixels(part(0), part(1), part(2), part(3), w, h), from_polygon(F.filter("polygon", lambda p: F.size(p) >= 2), w, h)
    columns = [F.coalesce(F.when(F.size("bbox") == 4, x), y).alias(n) for x, y, n in zip((a.x1, a.y1, a.x2, a.y2), (b.x1, b.y1, b.x2, b.y2), ("x1", "y1", "x2", "y2"), strict=True)]
    reading = t.strip(F.coalesce("text", F.lit("")))
    return rows.where(~F.lower(reading).isin(*t.NO_TEXT)).select("key", "pos", *columns, reading.alias("text"), F.coalesce("confidence", F.lit(1.0)).alias("confidence")).where("x2 > x1 AND y2 > y1")
