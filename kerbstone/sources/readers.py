"""Readers of the canonical formats; every one takes a path and gives a DataFrame with a fixed schema."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbstone.functions.text import INDEXED_STEM, seconds_to_ns, stem_index, stem_stamp, strip


def _stem(path: str = "_metadata.file_name"):
    return F.regexp_replace(F.col(path), r"\.[^.]*$", "")


def json_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``stem, path, doc`` of every JSON file, the content as VARIANT; the query fails on a file that is no JSON."""
    files = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", "*.json").load(folder)
    return files.select(_stem().alias("stem"), F.col("_metadata.file_path").alias("path"), F.parse_json("value").alias("doc"))


def indexed_records(spark: SparkSession, text_folder: str, graph_folder: str, sequence: str, require_text: bool = True) -> DataFrame:
    """``sequence, idx, ts, stem, text_path, graph_path`` of a walked recording, its stems naming index and stamp.

    ValueError where a graph has no text (unless not required), indices aren't 0, 1, 2, ..., or stamps go back.
    """
    listed = lambda folder, name: spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select(_stem().alias("stem"), F.col("path").alias(name))
    graphs = listed(graph_folder, "graph_path").where(F.col("stem").rlike(INDEXED_STEM))
    rows = graphs.join(listed(text_folder, "text_path"), "stem", "left").select(F.lit(sequence).alias("sequence"), stem_index(F.col("stem")).alias("idx"), stem_stamp(F.col("stem")).alias("ts"), "stem", "text_path", "graph_path")
    from kerbstone.sources.catalog import order_defects

    lacking = rows.where("text_path IS NULL").limit(3).collect() if require_text else []
    if lacking:
        raise ValueError(f"no text annotation for {', '.join(r['stem'] for r in lacking)}")
    bad = order_defects(rows).where("gaps > 0 OR backwards > 0").first()
    if bad:
        raise ValueError(f"{sequence}: {bad['gaps']} gaps in the indices, {bad['backwards']} stamps that go back")
    return rows


def ins_track(spark: SparkSession, path: str) -> DataFrame:
    """``ts, northing, easting`` of a CSV log; lines that lack a value or have none readable are skipped. ValueError if none is left."""
    raw = spark.read.option("header", "true").csv(path)
    rows = raw.select(F.expr("try_cast(trim(timestamp) AS BIGINT)").alias("ts"), F.expr("try_cast(trim(northing) AS DOUBLE)").alias("northing"), F.expr("try_cast(trim(easting) AS DOUBLE)").alias("easting")).dropna()
    if rows.isEmpty():
        raise ValueError(f"no usable position in {path}")
    return rows.orderBy("ts")


def poses(spark: SparkSession, path: str) -> DataFrame:
    """``stem, ts, tx, ty, tz`` of a CSV of poses, stamps in ns by their digits. ValueError for a stem given twice."""
    raw = spark.read.option("header", "true").csv(path)
    rows = raw.select(F.regexp_replace(F.element_at(F.split(F.translate("image", "\\", "/"), "/"), -1), r"\.[^.]*$", "").alias("stem"), seconds_to_ns(F.col("timestamp")).alias("ts"), *[F.expr(f"CAST(trim({c}) AS DOUBLE)").alias(c) for c in ("tx", "ty", "tz")])
    twice = rows.groupBy("stem").agg(F.count("*").alias("n")).where("n > 1").first()
    if twice:
        raise ValueError(f"{twice['stem']} has {twice['n']} poses")
    return rows


def with_poses(frames: DataFrame, known: DataFrame) -> DataFrame:
    """Frames (stem, ...) with stamp and position of their pose; ValueError for a frame without one."""
    lacking = frames.join(known, "stem", "left_anti").limit(3).collect()
    if lacking:
        raise ValueError(f"no pose for {', '.join(r['stem'] for r in lacking)}")
    return frames.drop("ts").join(known, "stem")


def frame_list(spark: SparkSession, path: str) -> DataFrame:
    """``stem``: the lines of a list, without blank ones and comments, each after its last slash. ValueError if there is none."""
    line = strip(F.col("value"))
    rows = spark.read.text(path).select(line.alias("l")).where((F.col("l") != "") & ~F.col("l").startswith("#")).select(F.substring_index("l", "/", -1).alias("stem")).distinct()
    if rows.isEmpty():
        raise ValueError(f"{path} names no frame")
    return rows


def correspondences(spark: SparkSession, path: str) -> DataFrame:
    """``line, query_ts, start_ts, end_ts``: a keyframe alone (ends null) or with the interval it corresponds to.

    Blank lines and comments are skipped; ValueError with its number for a line of another form.
    """
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "l")).select((F.col("n") + 1).alias("line"), strip(F.col("l")).alias("l")).where((F.col("l") != "") & ~F.col("l").startswith("#"))
    parts = rows.withColumn("p", F.transform(F.split("l", ","), strip))
    whole = F.size("p").isin(1, 3) & F.forall("p", lambda x: x.rlike(r"^-?\d+$"))
    bad = parts.where(~whole).orderBy("line").first()
    if bad:
        raise ValueError(f"{path}:{bad['line']}: expected one or three integers, not {bad['l']!r}")
    at = lambda i: F.get("p", F.lit(i)).cast("long")
    return parts.select("line", at(0).alias("query_ts"), at(1).alias("start_ts"), at(2).alias("end_ts"))


def vocabularies(spark: SparkSession, path: str) -> DataFrame:
    """``kind, name, idx`` of a manifest's two maps; ValueError unless ``unknown`` is 0 and indices have no gap."""
    text = spark.read.text(path, wholetext=True).first()[0]
    payload = json.loads(text)
    rows = [(kind, name, idx) for kind, key in (("node", "node_class_to_idx"), ("edge", "edge_label_to_idx")) for name, idx in payload[key].items()]
    for kind in ("node", "edge"):
        known = {n: i for k, n, i in rows if k == kind}
        if known.get("unknown") != 0 or sorted(known.values()) != list(range(len(known))):
            raise ValueError(f"the {kind} vocabulary of {path} isn't numbered from unknown = 0 without gaps")
    return spark.createDataFrame(rows, "kind string, name string, idx int")


def fold_assignment(spark: SparkSession, path: str) -> DataFrame:
    """``fold, part, stem`` of a fold document."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "assignment map<string, map<string, array<string>>>").alias("d"))
    parts = doc.select(F.explode("d.assignment").alias("fold", "p")).select("fold", F.explode("p").alias("part", "s"))
    return parts.select(F.col("fold").cast("int").alias("fold"), "part", F.explode("s").alias("stem"))


def image_descriptors(spark: SparkSession, folder: str) -> DataFrame:
    """``sequence, frame_id, v`` of ``{sequence}.npz`` archives (frame_ids, descriptors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import numpy as np

        for batch in batches:
            for stem, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as a:
                    ids, v = a["frame_ids"].astype(str), a["descriptors"].astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([stem] * len(ids)), pa.array(ids.tolist()), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["sequence", "frame_id", "v"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(folder)
    return files.select(_stem().alias("s"), "content").mapInArrow(run, "sequence string, frame_id string, v array<double>")


def images(spark: SparkSession, folder: str, stride: int = 1) -> DataFrame:
    """``path, stem, length`` of the png, jpg and jpeg files of a folder, every ``stride``-th by name."""
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").load(folder).drop("content").select("path", "length", F.col("_metadata.file_name").alias("name"))
    kept = files.where(F.lower("name").rlike(r"\.(png|jpe?g)$"))
    numbered = kept.withColumn("_k", F.row_number().over(Window.partitionBy(F.regexp_replace("path", r"[^/]*$", "")).orderBy("name")) - 1)
    return numbered.where(F.col("_k") % stride == 0).select("path", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), "length")
