"""Same or nearly the same records in the training split and in an evaluation split.

Equal contents are one class. Each class is sketched by minwise hashes of its word shingles, bands of
the sketch are joined between training and evaluation classes only, the exact Jaccard similarity of
a candidate pair is computed, and the word edit distance that defines an overlap decides. The result is links between classes and
the members of each; pairs of records are made of them on demand, and the report counts without making them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbstone.functions.jsontree import pieces
from kerbstone.runtime import hot_limit, materialise, salted_join, skewed_join

#: Words a content must have, and share of the longer content's words that edits may touch.
LEAST_WORDS, EDITS = 8, 0.1
#: Words of a shingle. An edit touches two of these, so two contents of n words within n/10 edits have
#: a similarity of 0.63 at least; five words would leave next to nothing.
SHINGLE = 2
#: Bands and rows of the sketch: a pair at 7/11, the least there is, is missed with a chance of 1 in 100,000. Fewer rows would leave more
#: candidates than bands save.
BANDS, ROWS = 64, 4
#: Classes, about, whose bands tell which are frequent; they only steer how the join is spread.
SAMPLE_CLASSES = 20_000


def words(content: Column) -> Column:
    return F.regexp_extract_all(F.lower(content), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def frame_key(path: Column) -> Column:
    """The last two segments without extension and case; null for fewer than two."""
    segments = F.filter(F.split(F.translate(F.lower(path), "\\", "/"), "/"), lambda s: s != "")
    last = F.regexp_replace(F.element_at(segments, -1), r"(?<=.)\.[^.]*$", "")
    return F.when(F.size(segments) >= 2, F.concat_ws("/", F.element_at(segments, -2), last))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_240_229)
    n = BANDS * ROWS
    return r.integers(1, 2**63, n, np.uint64) << np.uint64(1) | np.uint64(1), r.integers(0, 2**63, n, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def _occurrence(owner: np.ndarray, what: np.ndarray) -> np.ndarray:
    """How many equal ones of the same owner stand before each."""
    order = np.lexsort((what, owner))
    new = np.append(True, (owner[order][1:] != owner[order][:-1]) | (what[order][1:] != what[order][:-1]))[: len(order)]
    at = np.arange(len(order))
    out = np.empty(len(order), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def _numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text, word) of every word, the words as numbers, and what the numbers stand for."""
    split = pc.split_pattern(texts, " ")
    flat = split.flatten().dictionary_encode()
    return np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(split))), flat.indices.to_numpy().astype(np.int64), flat.dictionary.to_pylist()


def sketches(texts: pa.Array) -> np.ndarray:
    """A hash per text and band, of the smallest hashes of its shingles; repeats of a shingle are numbered, so that they count."""
    owner, word, names = _numbered(texts)
    h = np.array([xxhash.xxh64_intdigest(w) for w in names], np.uint64)[word]
    start = np.nonzero(owner[1:] == owner[:-1])[0]
    shingle = h[start]
    for k in range(1, SHINGLE):
        shingle = _mixed(shingle) + h[start + k]
    owner = owner[start]
    shingle = _mixed(shingle) + _occurrence(owner, shingle).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    first = np.searchsorted(owner, np.arange(len(texts)))
    out = np.zeros((len(texts), BANDS), np.uint64)
    for i, (a, b) in enumerate(zip(*_permutations(), strict=True)):
        v = shingle * a + b
        v ^= v >> np.uint64(29)
        out[:, i // ROWS] = _mixed(out[:, i // ROWS] ^ np.minimum.reduceat(v, first))
    return out ^ np.arange(BANDS, dtype=np.uint64) << np.uint64(56)


def edits_within(a: Sequence, b: Sequence, most: int) -> bool:
    """Whether at most ``most`` insertions, deletions and replacements of words turn a into b."""
    a, b = list(a), list(b)
    while a and b and a[-1] == b[-1]:
        a.pop()
        b.pop()
    lead = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[lead:], b[lead:]
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if m - n > most:
        return False
    if n <= 1:  # what is left differs at its ends
        return m - (n == 1 and a[0] in b) <= most
    number = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.array([number[w] for w in s]) for s in (a, b))
    # cell k of a row i stands for column i - most + k of the table
    width = 2 * most + 1
    far = 2 * (n + m)
    k = np.arange(width)
    column = k - most
    row = np.where((column >= 0) & (column <= m), column, far)
    padded = np.concatenate([np.full(most + 1, -1), y, np.full(n + most + 1, -1)])
    for i in range(1, n + 1):
        column = i - most + k
        same = padded[i : i + width] == x[i - 1]
        step = np.minimum(row + ~same, np.concatenate([row[1:], [far]]) + 1)
        step = np.where(column == 0, i, step)
        step = np.where((column < 0) | (column > m), far, step)
        row = np.minimum.accumulate(step - k) + k
        row = np.where((column < 0) | (column > m), far, row)
        if row.min() > most:
            return False
    return bool(row[m - n + most] <= most)


def similarities(a: pa.Array, b: pa.Array) -> np.ndarray:
    """The exact Jaccard similarity of the shingles of each two contents that overlap, NaN for others."""
    n = len(a)
    owner, word, names = _numbered(pa.concat_arrays([a, b]))
    length = np.bincount(owner, minlength=2 * n)
    longer = np.maximum(length[:n], length[n:])
    most = np.floor(longer * EDITS + 1e-9).astype(np.int64)
    start = np.nonzero(owner[1:] == owner[:-1])[0]
    shingle, of = word[start], owner[start]
    for k in range(1, SHINGLE):
        shingle = np.unique(shingle * len(names) + word[start + k], return_inverse=True)[1]
    times = _occurrence(of, shingle)
    key = (of % max(n, 1) * (shingle.max(initial=0) + 1) + shingle) * (times.max(initial=0) + 1) + times
    both = np.bincount(np.intersect1d(key[of < n], key[of >= n], assume_unique=True) // ((shingle.max(initial=0) + 1) * (times.max(initial=0) + 1)), minlength=n)
    total = np.bincount(of, minlength=2 * n)
    x, y = total[:n], total[n:]
    # each edit changes at most SHINGLE shingles of either content
    open_ = (np.abs(length[:n] - length[n:]) <= most) & (both >= np.maximum(x, y) - SHINGLE * most)
    ends = np.append(0, np.cumsum(length))
    out = np.full(n, np.nan)
    for i in np.nonzero(open_)[0].tolist():
        if edits_within(word[ends[i] : ends[i + 1]], word[ends[n + i] : ends[n + i + 1]], int(most[i])):
            out[i] = both[i] / (x[i] + y[i] - both[i])
    return out


def _seen(records: DataFrame) -> DataFrame:
    """Every row: record, part, source, frame key, words and their class; fewer than LEAST_WORDS have none."""
    part = F.lower(F.trim("split_part"))
    rows = records.where("record_id IS NOT NULL").select("record_id", part.alias("split_part"), "source", frame_key(F.col("file_path")).alias("frame"), words(F.col("content")).alias("w"))
    text = F.when(F.size("w") >= LEAST_WORDS, F.array_join("w", " "))
    return rows.where("split_part IN ('train', 'validation', 'test')").select("record_id", "split_part", "source", "frame", text.alias("text")).withColumn("class", F.unhex(F.md5("text")))


def distinct_records(records: DataFrame) -> DataFrame:
    """One row per record_id: part, source, frame key and class of content; of rows that differ the largest counts."""
    return _seen(records).groupBy("record_id").agg(F.max(F.struct("split_part", "source", "frame", "class")).alias("r")).select("record_id", "r.*")


def _bands(classes: DataFrame) -> DataFrame:
    """``band, id, n_words`` of every class and band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch.column(2)):
                keys = sketches(texts).view(np.int64)
                at = pa.array(first + np.repeat(np.arange(len(texts)), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column(0).take(at), batch.column(1).take(at)], names=["band", "id", "n_words"])

    return classes.select("id", "n_words", "text").mapInArrow(run, "band long, id long, n_words int")


def similar_classes(classes: DataFrame) -> DataFrame:
    """``class_t, class_e, similarity`` of a training class and another evaluation class that overlap.

    ``classes`` has ``id, class, text, n_words, n_train, n_eval``. A band met on one side only gives no candidate. Bands that a sample
    shows to be frequent are spread over a grid of tasks.
    """
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, a in pieces(batch.column(2)):
                part = batch.slice(first, len(a))
                s = similarities(a, part.column(3))
                keep = pa.array(~np.isnan(s))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep), pa.array(s).filter(keep)], names=["class_t", "class_e", "similarity"])

    train, evaluation = classes.where("n_train > 0"), classes.where("n_eval > 0")
    n = classes.count()
    share = min(1.0, SAMPLE_CLASSES / max(n, 1))
    sampled = classes.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    common = _bands(sampled).groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") * (1 / share) > hot_limit(n))
    cells = F.least(F.lit(32), F.ceil(F.col("n") / F.lit(share * hot_limit(n)))).cast("int")
    hot = materialise(common.select("band", cells.alias("left_cells"), cells.alias("right_cells")), "hot")
    side = lambda df, s: _bands(df).select("band", F.col("id").alias(f"id_{s}"), F.col("n_words").alias(f"n_{s}"))
    met = skewed_join(side(train, "t"), side(evaluation, "e"), "band", hot)
    near = met.where(F.col("id_t") != F.col("id_e")).where(F.abs(F.col("n_t") - F.col("n_e")) <= F.greatest("n_t", "n_e") * F.lit(EDITS) + 1e-9)
    pairs = near.select("id_t", "id_e").distinct()
    of = lambda df, s: df.select(F.col("id").alias(f"id_{s}"), F.col("class").alias(f"class_{s}"), F.col("text").alias(f"text_{s}"))
    looked_up = pairs.join(of(train, "t"), "id_t").join(of(evaluation, "e"), "id_e").select("class_t", "class_e", "text_t", "text_e")
    return looked_up.mapInArrow(verify, "class_t binary, class_e binary, similarity double")


@dataclass(frozen=True)
class Overlaps:
    """``records`` (record_id, split_part, source, frame, class): every record once, with the classes it is a member of; ``classes``
    (class, n_train, n_eval, ...); ``links`` (class_t, class_e, similarity) between classes whose members overlap."""

    records: DataFrame
    classes: DataFrame
    links: DataFrame

    def _sides(self) -> tuple[DataFrame, DataFrame]:
        train = F.col("split_part") == "train"
        return self.records.where(train), self.records.where(~train)

    def pairs(self) -> DataFrame:
        """``train_id, eval_id, split_part, source, same_frame, similarity``: every pair of records that overlap.

        ``similarity`` is the Jaccard similarity of the contents, null where only the frame is the same; ``split_part`` and ``source``
        are the evaluation record's. Members of frequent classes and frames are spread over grids of tasks.
        """
        limit = hot_limit(self.records.count())
        cells = lambda n: F.greatest(F.lit(1), F.least(F.lit(64), F.ceil(F.coalesce(n, F.lit(0)) / limit))).cast("int")
        hot = lambda counts, key: materialise(counts.where(F.greatest(F.coalesce("l", F.lit(0)), F.coalesce("r", F.lit(0))) > limit).select(key, cells(F.col("l")).alias("left_cells"), cells(F.col("r")).alias("right_cells")), "hot")
        t, e = self._sides()
        t, e = t.select(F.col("record_id").alias("train_id"), F.col("class").alias("class_t"), "frame"), e.select(F.col("record_id").alias("eval_id"), F.col("class").alias("class_e"), "split_part", "source", "frame")
        train_sizes, eval_sizes = self.classes.select(F.col("class").alias("class_t"), F.col("n_train").alias("r")), self.classes.select(F.col("class").alias("class_e"), F.col("n_eval").alias("r"))
        degree = self.links.groupBy("class_t").agg(F.count("*").alias("l"))
        first = skewed_join(self.links, t.select("train_id", "class_t"), "class_t", hot(degree.join(train_sizes, "class_t"), "class_t"))
        reached = self.links.join(train_sizes, "class_t").groupBy("class_e").agg(F.sum("r").alias("l"))
        by_content = skewed_join(first.drop("class_t"), e.drop("frame"), "class_e", hot(reached.join(eval_sizes, "class_e"), "class_e"))
        frames = self.records.where("frame IS NOT NULL").groupBy("frame").agg(F.count_if(F.col("split_part") == "train").alias("l"), F.count_if(F.col("split_part") != "train").alias("r"))
        by_frame = skewed_join(t.select("train_id", "frame"), e.drop("class_e"), "frame", hot(frames, "frame"))
        names = ["train_id", "eval_id", "split_part", "source"]
        both = by_content.select(*names, F.lit(False).alias("same_frame"), "similarity").unionByName(by_frame.select(*names, F.lit(True).alias("same_frame"), F.lit(None).cast("double").alias("similarity")))
        return both.groupBy("train_id", "eval_id").agg(F.first("split_part").alias("split_part"), F.first("source").alias("source"), F.bool_or("same_frame").alias("same_frame"), F.max("similarity").alias("similarity"))

    def report(self) -> DataFrame:
        """Overlaps per evaluation split and source: pairs, distinct evaluation records, pairs by frame and by content.

        Counted from the sizes of classes and frames; no pair of records is made.
        """
        t, e = self._sides()
        asked = e.groupBy("split_part", "source", F.col("class").alias("class_e"), "frame").agg(F.count("*").alias("m"))
        sizes = self.classes.select(F.col("class").alias("class_t"), "n_train")
        by_content = self.links.join(sizes, "class_t").groupBy("class_e").agg(F.sum("n_train").alias("by_content"))
        by_frame = t.where("frame IS NOT NULL").groupBy("frame").agg(F.count("*").alias("by_frame"))
        held = t.where("frame IS NOT NULL AND class IS NOT NULL").groupBy(F.col("class").alias("class_t"), "frame").agg(F.count("*").alias("n"))
        met = asked.where("frame IS NOT NULL AND class_e IS NOT NULL").select("class_e", "frame").distinct()
        # training records that show an evaluation record's frame and have linked content as well
        linked = self.links.select("class_t", "class_e").join(held, "class_t").groupBy("class_e", "frame").agg(F.sum("n").alias("twice"))
        twice = linked.join(met, ["class_e", "frame"], "left_semi")
        counted = salted_join(salted_join(asked, by_content, ["class_e"], "m", how="left"), by_frame, ["frame"], "class_e", how="left").join(twice, ["class_e", "frame"], "left").fillna(0, ["by_content", "by_frame", "twice"])
        each = F.col("by_content") + F.col("by_frame") - F.col("twice")
        total = lambda c: F.sum(F.col("m") * c)
        got = counted.where(each > 0).groupBy("split_part", "source").agg(total(each).alias("pairs"), F.sum("m").alias("records"), total(F.col("by_frame")).alias("same_frame"), total(F.col("by_content")).alias("similar_content"))
        return got


def overlaps(split_records: DataFrame) -> Overlaps:
    """Each training record and each validation or test record that show the same frame or have nearly the same content.

    Records without a known part take no part; contents of fewer than LEAST_WORDS words, null paths and paths of fewer than two
    segments relate nothing.
    """
    records = materialise(distinct_records(split_records), "records")
    train = F.col("split_part") == "train"
    counts = records.where("class IS NOT NULL").groupBy("class").agg(F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_eval"))
    texts = _seen(split_records).where("class IS NOT NULL").groupBy("class").agg(F.first("text").alias("text"))
    known = texts.join(counts.hint("merge"), "class").withColumn("n_words", F.size(F.split("text", " ")))
    classes = materialise(known.withColumn("id", F.monotonically_increasing_id()), "classes")
    same = classes.where("n_train > 0 AND n_eval > 0").select(F.col("class").alias("class_t"), F.col("class").alias("class_e"), F.lit(1.0).alias("similarity"))
    links = materialise(similar_classes(classes).unionByName(same), "links")
    return Overlaps(records, classes.drop("text"), links)
