"""One consistent form for texts that look the same.

A batch of Arrow strings becomes one numpy array of code points. Lookup tables give each code point
its expansion (width, ligatures and accents taken apart, blanks made spaces, invisible characters
gone, letters drawn alike made one), offsets place the expansions, and marks are ordered and composed
by array operations. No string of a single row is ever built.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters drawn alike, Cyrillic and Greek ones under the Latin letter, then pairs of
#: the two under the Cyrillic one.
DRAWN_ALIKE = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜϺ", "N": "Ν",
    "O": "ОΟ", "P": "РΡ", "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥҮ", "Z": "Ζ",
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оο", "p": "рρ", "q": "ԛ", "s": "ѕ",
    "v": "νѵ", "w": "ԝ", "x": "х", "y": "уү",
    "Г": "Γ", "П": "Π", "Ф": "Φ", "к": "κ",
}
#: Ligatures without a decomposition.
LIGATURES = {"Œ": "OE", "œ": "oe", "Æ": "AE", "æ": "ae"}
#: Kinds of compatibility forms that don't change the look.
_SAME_LOOK = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Characters without a look that are no format characters.
_INVISIBLE = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x2065, 0x3164, 0xFFA0)
_SPACE = 0x20
_LIMIT = 0x110000
_HANGUL = (0xAC00, 0xD7A4)


def _decomposed(c: str) -> str:
    """Full decomposition by canonical forms and those that keep the look."""
    d = unicodedata.decomposition(c)
    if not d:
        return c
    kind, _, rest = d.partition(" ")
    if kind[0] == "<" and (kind not in _SAME_LOOK or rest.startswith("0020 ") or c == "ſ"):
        return c
    return "".join(_decomposed(chr(int(p, 16))) for p in (rest if kind[0] == "<" else d).split())


@dataclass(frozen=True)
class Tables:
    """``flat[start[c] : start[c] + length[c]]`` is the expansion of c; ``rank`` its combining class;
    ``pairs`` and ``composed`` are the sorted compositions (first << 21 | second)."""

    start: np.ndarray
    length: np.ndarray
    flat: np.ndarray
    rank: np.ndarray
    pairs: np.ndarray
    composed: np.ndarray


@lru_cache(maxsize=1)
def tables() -> Tables:
    """Built once per process, by rule, from the character database of the interpreter."""
    alike = {ord(o): ord(latin) for latin, others in DRAWN_ALIKE.items() for o in others}
    start = np.arange(_LIMIT, dtype=np.int32)
    length = np.ones(_LIMIT, np.int8)
    extra: list[int] = []
    rank = np.zeros(_LIMIT, np.uint8)
    pairs, composed = [], []
    for code in (*range(0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE1000)):
        c = chr(code)
        rank[code] = unicodedata.combining(c)
        if _HANGUL[0] <= code < _HANGUL[1]:
            continue
        category = unicodedata.category(c)
        if category == "Cf" or code in _INVISIBLE or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            length[code] = 0
            continue
        if c.isspace() or category == "Zs":
            start[code] = _SPACE
            continue
        raw = "".join(map(_decomposed, LIGATURES.get(c, c)))
        out = [alike.get(ord(x), ord(x)) for x in raw]
        if out != [code]:
            start[code], length[code] = _LIMIT + len(extra), len(out)
            extra += out
        d = unicodedata.decomposition(c)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", c) == c:
            a, b = (alike.get(int(p, 16), int(p, 16)) for p in d.split())
            pairs.append(a << 21 | b)
            composed.append(code)
    # two scripts may compose to the same look (Й from two letters drawn alike): the smallest code point stands for it
    lead, vowel, tail = np.arange(0x1100, 0x1113), np.arange(0x1161, 0x1176), np.arange(0x11A8, 0x11C3)
    two = 0xAC00 + (np.arange(19)[:, None] * 21 + np.arange(21)[None, :]) * 28
    pairs += (lead[:, None] << 21 | vowel[None, :]).ravel().tolist() + (two.ravel()[:, None] << 21 | tail[None, :]).ravel().tolist()
    composed += two.ravel().tolist() + (two.ravel()[:, None] + np.arange(1, 28)[None, :]).ravel().tolist()
    p, k = np.array(pairs, np.int64), np.array(composed, np.int32)
    order = np.lexsort((k, p))
    p, k = p[order], k[order]
    first = np.concatenate([[True], p[1:] != p[:-1]])
    return Tables(start, length, np.concatenate([np.arange(_LIMIT, dtype=np.int32), np.array(extra, np.int32)]), rank, p[first], k[first])


def _code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, first of each row and the end) of a string column without nulls' bytes."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = data.to_pybytes()[offsets[0] : offsets[-1]] if data is not None else b""
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32).astype(np.int32), lead[offsets - offsets[0]]


def _strings(codes: np.ndarray, row: np.ndarray, rows: int, nulls: np.ndarray) -> pa.Array:
    size = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, weights=size, minlength=rows).astype(np.int64))])
    data = codes.astype("<u4").tobytes().decode("utf-32-le").encode()
    valid = pa.py_buffer(np.packbits(~nulls, bitorder="little").tobytes()) if nulls.any() else None
    return pa.Array.from_buffers(pa.large_string(), rows, [valid, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data)])


def _compose(codes: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Puts marks in canonical order, then joins each with its starter where that isn't blocked."""
    n = len(codes)
    rank = t.rank[codes]
    starter = rank == 0
    fresh = np.concatenate([[True], row[1:] != row[:-1]]) if n else np.zeros(0, bool)
    cluster = np.cumsum(starter | fresh)
    order = np.lexsort((np.arange(n), rank, cluster))
    # a cluster begins with its starter, if it has one, since that has rank 0
    codes, row = codes[order], row[order]
    while True:
        n = len(codes)
        if n < 2:
            return codes, row
        rank = t.rank[codes]
        at = np.arange(n)
        fresh = np.concatenate([[True], row[1:] != row[:-1]])
        base = np.maximum.accumulate(np.where((rank == 0) | fresh, at, 0))
        base_before = np.concatenate([[0], base[:-1]])
        s = np.where(rank == 0, base_before, base)  # a starter may join the one before it
        adjacent = s == at - 1
        before = np.concatenate([[0], rank[:-1]])
        open_ = ~fresh & (s < at) & (row[s] == row) & (rank[s] == 0) & (adjacent | ((rank > 0) & (before < rank)))
        key = codes[s].astype(np.int64) << 21 | codes
        found = np.minimum(np.searchsorted(t.pairs, key), len(t.pairs) - 1)
        joins = open_ & (t.pairs[found] == key)
        if not joins.any():
            return codes, row
        where = np.nonzero(joins)[0]
        # one join per starter and pass, and none whose starter joins another in this pass
        firsts = where[np.unique(s[where], return_index=True)[1]]
        firsts = firsts[~np.isin(s[firsts], firsts)]
        codes = codes.copy()
        codes[s[firsts]] = t.composed[found[firsts]]
        keep = np.ones(n, bool)
        keep[firsts] = False
        codes, row = codes[keep], row[keep]


def consistent_form(column: pa.Array) -> pa.Array:
    """The form of each text; null for null. Blanks at the ends go, runs of them become one space."""
    t = tables()
    rows = len(column)
    nulls = column.is_null().to_numpy(zero_copy_only=False)
    codes, first = _code_points(column.fill_null(""))
    row = np.repeat(np.arange(rows), np.diff(first))
    length = t.length[codes].astype(np.int64)
    total = int(length.sum())
    lead = np.cumsum(length) - length
    out = t.flat[np.repeat(t.start[codes] - lead, length) + np.arange(total)] if total else np.zeros(0, np.int32)
    row = np.repeat(row, length)
    blank = out == _SPACE
    if total:
        new = np.concatenate([[True], row[1:] != row[:-1]])
        after_blank = np.concatenate([[False], blank[:-1]]) & ~new
        keep = ~(blank & (new | after_blank))
        out, row, blank = out[keep], row[keep], blank[keep]
    if len(out):
        last = np.concatenate([row[1:] != row[:-1], [True]])
        keep = ~(blank & last)
        out, row = out[keep], row[keep]
    out, row = _compose(out, row, t)
    return _strings(out, row, rows, nulls).cast(pa.string())


def with_form(rows: DataFrame, text: str, form: str = "form") -> DataFrame:
    """Adds the consistent form of a string column; other columns stay, a column of that name is replaced."""
    kept = [c for c in rows.columns if c != form]
    at = kept.index(text)
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != form), T.StructField(form, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, consistent_form(batch.column(at))], names=[*kept, form])

    return rows.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def detections(frame_texts: DataFrame) -> DataFrame:
    """``ann_id, det_pos, text`` of each detection with a text; rows of a null ann_id are left out."""
    return frame_texts.where("ann_id IS NOT NULL").select("ann_id", F.posexplode("detections").alias("det_pos", "d")).select("ann_id", "det_pos", F.col("d.text").alias("text")).where("text IS NOT NULL")


#: Signs that may be broadcast; a larger lexicon is joined by shuffling.
BROADCAST_SIGNS = 100_000


def misread_signs(frame_texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``ann_id, det_pos, sign_id``: detections that look like a sign but have other characters.

    Each triple once, however often an annotation was delivered. A text without any visible
    character looks like no sign; of signs that look alike each is reported.
    """
    seen = with_form(detections(frame_texts), "text").where("form <> ''")
    signs = with_form(lexicon.where("sign_id IS NOT NULL AND text IS NOT NULL").select("sign_id", F.col("text").alias("sign")), "sign").where("form <> ''")
    signs = F.broadcast(signs) if lexicon.count() <= BROADCAST_SIGNS else signs
    return seen.join(signs, "form").where("text <> sign").select("ann_id", "det_pos", "sign_id").distinct()
