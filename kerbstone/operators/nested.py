"""Deeply nested records as related flat tables, by Dewey labels.

Every value of a JSON text gets the path of ordinals that leads to it (``"0.3.1"``, the root
is ``""``). A parent's label is its child's without the last ordinal, so parent-child links need no
generated keys, and the values of one schema path (``$.nodes[].id``) form one table. A text is never split over tasks, so
tables of the same text are related where they arise, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbstone.functions import jsontree, jsonvalue
from kerbstone.functions.jsontree import ARRAY, BOOLEAN, KINDS, NULL, NUMBER, OBJECT, STRING, Forest
from kerbstone.runtime import scratch_path

SHREDDED = "record_id long, dewey string, schema_path string, kind string, ordinal int, value string, number double, size int, numbers int"
#: Folders the tables of a corpus are written to, however many schema paths it has.
FOLDERS = 512


def step(name: str) -> str:
    """A member's part of a schema path; what separates parts is escaped in names."""
    return "." + re.sub(r"[.\[\]\\]", r"\\\g<0>", name)


def schema_paths(f: Forest, wanted: frozenset[str] | None = None) -> tuple[np.ndarray, list[str]]:
    """An index into the list of paths for each value; -1 for those that neither are nor lead to a wanted path."""
    paths: list[str] = ["$"]
    at = np.full(len(f), -1)
    at[f.parent < 0] = 0
    deepest = None if wanted is None else max((len(re.findall(r"(?<!\\)\.|(?<!\\)\[", p)) for p in wanted), default=0)
    for rows in f.levels():
        level = f.level[rows[0]]
        if level == 0:
            continue
        if deepest is not None and level > deepest:
            break
        above = at[f.parent[rows]]
        rows, above = rows[above >= 0], above[above >= 0]
        key = above * (len(f.names) + 1) + f.name[rows] + 1
        distinct, back = np.unique(key, return_inverse=True)
        new = np.full(len(distinct), -1)
        for i, k in enumerate(distinct.tolist()):
            up, name = divmod(k, len(f.names) + 1)
            path = paths[up] + (step(f.names[name - 1]) if name else "[]")
            if wanted is None or any(w == path or w.startswith((path + ".", path + "[")) for w in wanted):
                new[i] = len(paths)
                paths.append(path)
        at[rows] = new[back]
    return at, paths


def _integers(column: np.ndarray) -> pa.Array:
    return pa.array(column, pa.int32())


def shred(records: DataFrame, record_id: str, content: str, paths: Iterable[str] | None = None) -> DataFrame:
    """One row per JSON value of ``content``: its record, Dewey label, schema path, kind, ordinal
    under its parent, text of a scalar and value of a number, number of members and of numbers among them.

    ``paths`` limits the rows to those schema paths; ``.``, ``[``, ``]`` and ``\\`` in member names are escaped there. Null, empty and
    invalid content gives no row, nesting has no limit; a record id delivered twice is shredded twice
    (reduce it before, see ``distinct_records``).
    """
    wanted = None if paths is None else frozenset(paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in jsontree.pieces(batch.column(1)):
                f = jsontree.parse(texts)
                path, named = schema_paths(f, wanted)
                spelling = pa.array(named, pa.string())
                keep = np.array([wanted is None or p in wanted for p in named])
                members, numbers = f.members(), f.members(NUMBER)
                label = pa.nulls(0, pa.string())
                place = np.full(len(f), -1)
                for rows in f.levels():
                    rows = rows[path[rows] >= 0]
                    if not len(rows):
                        break
                    # a label is its parent's and the ordinal; labels of one level are enough for the next
                    if f.level[rows[0]] == 0:
                        label = pa.array([""] * len(rows), pa.string())
                    else:
                        own = _integers(f.ordinal[rows]).cast(pa.string())
                        label = own if f.level[rows[0]] == 1 else pc.binary_join_element_wise(label.take(pa.array(place[f.parent[rows]])), own, ".")
                    place[rows] = np.arange(len(rows))
                    use = keep[path[rows]]
                    out = rows[use]
                    if not len(out):
                        continue
                    kind = f.kind[out]
                    scalar = (kind > ARRAY) & (kind != NULL)
                    blank = pa.array(~scalar)
                    value = pc.if_else(blank, pa.scalar(None, pa.string()), f.spelled(out))
                    number = pc.if_else(pa.array(kind == NUMBER), value, pa.scalar(None, pa.string())).cast(pa.float64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(first + f.text[out])), label.filter(pa.array(use)), spelling.take(pa.array(path[out])), pa.array(KINDS[kind].tolist(), pa.string()), _integers(f.ordinal[out]), value, number, _integers(members[out]), _integers(numbers[out])],
                        schema=_schema(),
                    )

    return records.where(F.col(content).isNotNull()).select(F.col(record_id).cast("long"), F.col(content).cast("string")).mapInArrow(run, SHREDDED)


def _schema() -> pa.Schema:
    types = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    return pa.schema([(n, types[t]) for n, t in (c.strip().split(" ") for c in SHREDDED.split(","))])


def distinct_records(records: DataFrame, record_id: str, content: str) -> DataFrame:
    """One row per id; of rows with other content under one id the largest content counts. Null ids go."""
    return records.where(F.col(record_id).isNotNull()).groupBy(record_id).agg(F.max(content).alias(content))


def parent(dewey: Column) -> Column:
    """The parent's label, by truncation; the root's children have the parent ``""``."""
    return F.when(F.instr(dewey, ".") > 0, F.regexp_replace(dewey, r"\.[^.]*$", "")).otherwise(F.lit(""))


@dataclass(frozen=True)
class Tables:
    """A flat table per schema path, written once; reading one of them reads its folder only."""

    spark: SparkSession
    path: str
    schema: str

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).drop("folder")

    def paths(self) -> DataFrame:
        """``schema_path, rows`` of every table."""
        return self.all().groupBy("schema_path").agg(F.count("*").alias("rows"))

    def table(self, schema_path: str) -> DataFrame:
        """The values of one path, each with its label and its parent's."""
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        number = self.spark.range(1).select(_folder(F.lit(schema_path))).first()[0]
        return rows.where((F.col("folder") == number) & (F.col("schema_path") == schema_path)).drop("folder")


def _folder(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(FOLDERS)).cast("int")


def tables(shredded: DataFrame) -> Tables:
    """The values of each schema path as a table of their own, with the label of the parent; the values are shredded once. Rows of a
    path are spread over tasks, as one path may hold most of them."""
    spark = shredded.sparkSession
    path = scratch_path(spark, "tables")
    rows = shredded.withColumn("parent", parent(F.col("dewey"))).withColumn("folder", _folder(F.col("schema_path")))
    rows.repartition("folder", F.pmod(F.xxhash64("record_id"), F.lit(8))).write.partitionBy("folder").parquet(path)
    return Tables(spark, path, f"{SHREDDED}, parent string, folder int")


#: Tables of a frame annotation by schema path: elements, and what hangs on them, in both spellings of a scene graph.
_ELEMENTS = {"$.nodes[]": "node", "$.links[]": "link", "$.edges[]": "link", "$.detections[]": "detection"}
_ATTRIBUTES = (
    "$.nodes[].id", "$.nodes[].data", "$.nodes[].bbox_2d", "$.nodes[].bbox_2d.xyxy", "$.nodes[].bbox",
    "$.nodes[].data.bbox_2d", "$.nodes[].data.bbox_2d.xyxy", "$.nodes[].data.bbox", "$.detections[].box",
    "$.links[].source", "$.links[].target", "$.edges[].source", "$.edges[].target",
)
_WANTED = frozenset([*_ELEMENTS, *_ATTRIBUTES, "$.links"])
CHILDREN = ("node", "link", "detection", "node_box", "detection_box")


class _Related:
    """The tables of one piece by schema path, each a list of values with its labels; a label is a row of ordinals."""

    def __init__(self, f: Forest) -> None:
        self.forest = f
        at, paths = schema_paths(f, _WANTED)
        self.rows = {p: np.nonzero(at == i)[0] for i, p in enumerate(paths) if p in _WANTED}
        # the first two ordinals of each label, as a number with the text in front
        ordinals = [f.ordinal, f.ordinal]
        width = [int(o.max(initial=0)) + 1 for o in ordinals]
        two = np.full(len(f), -1)
        for rows in f.levels():
            level = f.level[rows[0]]
            if level == 1:
                two[rows] = (f.text[rows] * width[0] + f.ordinal[rows]) * width[1]
            elif level == 2:
                two[rows] = two[f.parent[rows]] + f.ordinal[rows]
            elif level > 5:
                break
            elif level:
                two[rows] = two[f.parent[rows]]
        self.cut = two

    def table(self, path: str, kind: int | None = None) -> np.ndarray:
        rows = self.rows.get(path, np.zeros(0, np.int64))
        return rows if kind is None else rows[self.forest.kind[rows] == kind]

    def owners(self, elements: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``elements``, row) of the rows whose label, cut to two ordinals, is an element's."""
        labels = self.cut[elements]
        place = np.minimum(np.searchsorted(labels, self.cut[rows]), max(len(labels) - 1, 0))
        own = labels[place] == self.cut[rows] if len(labels) else np.zeros(len(rows), bool)
        return place[own], rows[own]

    def has(self, elements: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(elements), bool)
        out[self.owners(elements, rows)[0]] = True
        return out

    def keys(self, elements: np.ndarray, rows: np.ndarray, known: dict) -> np.ndarray:
        """A number per scalar of each element, equal for equal ones; numbers, strings and truth values are kept apart, -1 without."""
        f, out = self.forest, np.full(len(elements), -1)
        place, rows = self.owners(elements, rows)
        for kind in (STRING, NUMBER, BOOLEAN):
            of = f.kind[rows] == kind
            spelled = f.spelled(rows[of]).dictionary_encode()
            same = [known.setdefault((kind, jsonvalue.figures(s) if kind == NUMBER else s), len(known)) for s in spelled.dictionary.to_pylist()]
            if same:
                out[place[of]] = np.array(same)[spelled.indices.to_numpy()]
        return out


def _children(f: Forest) -> list[tuple[np.ndarray, int, np.ndarray, np.ndarray | int, np.ndarray | int]]:
    """(text, child, position, source's, target's) of the elements and boxes of a piece."""
    t = _Related(f)
    members, numbers = f.members(), f.members(NUMBER)
    four = lambda rows: rows[(f.kind[rows] == ARRAY) & (members[rows] == 4) & (numbers[rows] == 4)]
    given = lambda rows: rows[f.kind[rows] != NULL]
    nodes, detections = t.table("$.nodes[]", OBJECT), t.table("$.detections[]", OBJECT)
    has = lambda path, pick: t.has(nodes, pick(t.table("$.nodes[]" + path)))
    inner = np.where(has(".data.bbox_2d", given), has(".data.bbox_2d.xyxy", four), has(".data.bbox", four))
    outer = np.where(has(".bbox_2d", given), has(".bbox_2d.xyxy", four), has(".bbox", four))
    boxed = np.where(has(".data", given), inner, outer)
    linked = np.zeros(int(f.text.max(initial=-1)) + 1, bool)
    linked[f.text[given(t.table("$.links"))]] = True
    edges = t.table("$.edges[]", OBJECT)
    edges = edges[~linked[f.text[edges]]]
    known: dict = {}
    ids = t.keys(nodes, t.table("$.nodes[].id"), known)
    ends = [(table, [t.keys(table, t.table(f"$.{name}[].{end}"), known) for end in ("source", "target")]) for name, table in (("links", t.table("$.links[]", OBJECT)), ("edges", edges))]
    # the last node of each text with an id
    own = f.text[nodes] * (len(known) + 1) + ids
    order = np.argsort(own, kind="stable")
    order = order[ids[order] >= 0]
    last = np.nonzero(np.append(own[order][1:] != own[order][:-1], True))[0] if len(order) else order
    labels, places = own[order[last]], f.ordinal[nodes[order[last]]]

    def position(table: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(labels):
            return np.full(len(table), -1)
        asked = f.text[table] * (len(known) + 1) + end
        at = np.minimum(np.searchsorted(labels, asked), len(labels) - 1)
        return np.where((end >= 0) & (labels[at] == asked), places[at], -1)

    rows = lambda table, child: (f.text[table], CHILDREN.index(child), f.ordinal[table], -1, -1)
    out = [rows(nodes, "node"), rows(nodes[boxed], "node_box"), rows(detections, "detection"), rows(detections[t.has(detections, four(t.table("$.detections[].box")))], "detection_box")]
    return out + [(f.text[table], CHILDREN.index("link"), f.ordinal[table], position(table, a), position(table, b)) for table, (a, b) in ends]


def annotation_children(files: DataFrame) -> DataFrame:
    """``file_id, child, pos, source_pos, target_pos`` of every annotation with valid JSON.

    ``child`` is ``node``, ``link``, ``detection``, or ``node_box`` / ``detection_box`` at the
    position of their owner. Elements that aren't objects count in positions only. ``links`` that
    is absent or null gives way to ``edges``. A link end is the last node with that id, numbers
    and strings kept apart; -1 where there is none or the id is absent, null or nested. Null ids of files and null content go; of
    contents delivered under one id the one with the largest checksum counts.

    Attributes find the element that owns them by their label, cut to two ordinals. Only the
    children of a file are shuffled, to count a file delivered again once, never its text.
    """
    child = pa.struct([("child", pa.int8()), ("pos", pa.int32()), ("source_pos", pa.int32()), ("target_pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in jsontree.pieces(batch.column(2)):
                f = jsontree.parse(texts)
                found = _children(f)
                text = np.concatenate([t for t, *_ in found])
                order = np.argsort(text, kind="stable")
                columns = [pa.array(np.concatenate([np.broadcast_to(part[i], len(part[0])) for part in found])[order], child.field(i - 1).type) for i in range(1, 5)]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))])
                children = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(child)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)), children], names=["file_id", "checksum", "children"])

    given = files.where("file_id IS NOT NULL AND content IS NOT NULL").select(F.col("file_id").cast("long"), F.xxhash64("content").alias("checksum"), F.col("content").cast("string"))
    parsed = given.mapInArrow(run, "file_id long, checksum long, children array<struct<child: tinyint, pos: int, source_pos: int, target_pos: int>>")
    once = parsed.groupBy("file_id").agg(F.max_by("children", "checksum").alias("children"))
    name = F.element_at(F.array(*map(F.lit, CHILDREN)), F.col("child") + 1)
    return once.select("file_id", F.inline("children")).select("file_id", name.alias("child"), "pos", "source_pos", "target_pos")
