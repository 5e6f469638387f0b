"""Masks of frames as compressed run lengths, and how much of a box they cover."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _runs(mask: np.ndarray) -> list[int]:
    """Lengths of runs down the columns, the first one of unset pixels."""
    flat = np.asarray(mask, bool).ravel(order="F")
    change = np.flatnonzero(np.diff(flat)) + 1
    edges = np.concatenate([[0], change, [len(flat)]])
    lengths = np.diff(edges).tolist()
    return [0, *lengths] if len(flat) and flat[0] else lengths


def _pack(runs: Sequence[int]) -> str:
    """The published text form: from the fourth run on the difference to the run two before, in five-bit
    groups, low ones first, with a continuation bit, shifted into printable characters."""
    out = []
    for i, run in enumerate(runs):
        x = run - runs[i - 2] if i > 2 else run
        more = True
        while more:
            group = x & 0x1F
            x >>= 5
            more = x != (-1 if group & 0x10 else 0)
            out.append(chr((group | 0x20 if more else group) + 48))
    return "".join(out)


def _unpack(text: str) -> list[int]:
    runs: list[int] = []
    at = 0
    while at < len(text):
        x = shift = 0
        while True:
            group = ord(text[at]) - 48
            at += 1
            x |= (group & 0x1F) << shift
            shift += 5
            if not group & 0x20:
                if group & 0x10:
                    x -= 1 << shift
                break
        runs.append(x + runs[-2] if len(runs) > 2 else x)
    return runs


def encode_mask(mask: np.ndarray) -> dict | None:
    """``size`` (height, width) and ``counts``; None for a mask without a set pixel."""
    mask = np.asarray(mask, bool)
    return {"size": [int(n) for n in mask.shape], "counts": _pack(_runs(mask))} if mask.any() else None


def decode_mask(coded: dict | None, shape: tuple[int, int]) -> np.ndarray:
    if coded is None:
        return np.zeros(shape, bool)
    runs = _unpack(coded["counts"])
    flat = np.repeat(np.arange(len(runs)) % 2 == 1, runs)
    return flat.reshape(tuple(coded["size"]), order="F")


def union(masks: Iterable[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape, bool)
    for m in masks:
        out |= fitted(m, shape)
    return out


def fitted(mask: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The mask at another size by nearest pixels, still a mask."""
    mask = np.asarray(mask, bool)
    if mask.shape == tuple(shape):
        return mask
    pick = lambda n, m: np.minimum(((np.arange(n) + 0.5) * m / n).astype(int), m - 1)
    return mask[np.ix_(pick(shape[0], mask.shape[0]), pick(shape[1], mask.shape[1]))]


def covered_fraction(box: Sequence[float], mask: np.ndarray) -> float:
    """Share of a normalized box's pixels that are set; 0 for a box thinner than a pixel."""
    height, width = mask.shape
    x1, y1 = max(0, round(box[0] * width)), max(0, round(box[1] * height))
    x2, y2 = min(width, round(box[2] * width)), min(height, round(box[3] * height))
    patch = mask[y1:y2, x1:x2]
    return float(patch.sum()) / patch.size if patch.size else 0.0


def mask_of_boxes(boxes: Column, width: Column, height: Column) -> Column:
    """A frame's mask from normalized boxes (the union of their pixels) as ``struct<size, counts>``; null when none is set."""

    def run(boxes: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
        rows = []
        for bs, w, h in zip(boxes, width, height, strict=True):
            mask = np.zeros((h, w), bool)
            for b in bs if bs is not None else ():
                mask[round(b[1] * h) : round(b[3] * h), round(b[0] * w) : round(b[2] * w)] = True
            rows.append(encode_mask(mask) or {"size": None, "counts": None})
        return pd.DataFrame(rows, columns=["size", "counts"])

    coded = F.pandas_udf(run, "struct<size: array<int>, counts: string>")(boxes, width, height)
    return F.when(coded["counts"].isNotNull(), coded)


def dynamic_scores(boxes: Column, mask: Column, width: Column, height: Column) -> Column:
    """The covered share of each box, in order: none for no box, zeros where the segmenter found nothing."""

    def run(boxes: pd.Series, mask: pd.DataFrame, width: pd.Series, height: pd.Series) -> pd.Series:
        out = []
        for bs, size, counts, w, h in zip(boxes, mask["size"], mask["counts"], width, height, strict=True):
            if counts is not None and list(size) != [h, w]:
                raise ValueError(f"text and masks describe different frames: {(h, w)} and {list(size)}")
            m = decode_mask(None if counts is None else {"size": list(size), "counts": counts}, (h, w))
            out.append([covered_fraction(b, m) for b in bs] if bs is not None else [])
        return pd.Series(out)

    return F.pandas_udf(run, "array<double>")(boxes, mask, width, height)
