"""JSON documents of strings per frame, written from and read into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbstone.functions.geometry import is_valid_box

SCHEMA = "frame_id string, image_size array<int>, model_identity map<string,string>, detections array<struct<box: array<double>, text: string, confidence: double, dynamic_score: double>>"


def frame_text_to_json(frame_texts: DataFrame) -> DataFrame:
    """``ann_id, content``: one document per annotation; a null score is left out of it."""
    one = frame_texts.where("ann_id IS NOT NULL").groupBy("ann_id").agg(F.max_by(F.struct("frame_id", "image_size", "model_identity", "detections"), F.struct("written_at", F.xxhash64("detections"))).alias("r"))
    return one.select("ann_id", F.to_json("r", {"ignoreNullFields": "true"}).alias("content"))


def frame_text_rows(documents: DataFrame, strict: bool = False) -> DataFrame:
    """``ann_id, frame_id, det_pos, box, text, confidence, dynamic_score`` of documents (ann_id, content).

    With ``strict`` the query fails on a document that can't be read, has no positive image size, or holds an
    invalid box, an infinite confidence or a score beyond [0, 1]; without, such documents stay as they are and
    unreadable ones give no row.
    """
    parsed = documents.select("ann_id", F.from_json("content", SCHEMA).alias("r"))
    if strict:
        d = lambda test: F.coalesce(F.forall("r.detections", test), F.lit(True))
        good = (
            F.coalesce(F.size("r.image_size") == 2, F.lit(False))
            & F.coalesce(F.forall("r.image_size", lambda n: n > 0), F.lit(False))
            & d(lambda x: is_valid_box(x.getField("box")) & x.getField("text").isNotNull())
            & d(lambda x: F.coalesce(~F.isnan(x.getField("confidence")) & (F.abs(x.getField("confidence")) < float("inf")), F.lit(False)))
            & d(lambda x: F.coalesce(x.getField("dynamic_score").between(0.0, 1.0), x.getField("dynamic_score").isNull()))
        )
        parsed = parsed.withColumn("r", F.when(good, F.col("r")).otherwise(F.raise_error(F.concat(F.lit("not a valid annotation: "), F.col("ann_id").cast("string"))).cast(parsed.schema["r"].dataType)))
    rows = parsed.select("ann_id", "r.frame_id", F.posexplode("r.detections").alias("det_pos", "d"))
    return rows.select("ann_id", "frame_id", "det_pos", "d.box", "d.text", "d.confidence", "d.dynamic_score")
