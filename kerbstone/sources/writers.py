"""Writers: atomic single documents on the driver, and tables through Spark's committers."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Mapping
from typing import Any

import numpy as np
from pyspark.sql import DataFrame


def save_json(payload: Any, path: str) -> None:
    """A readable document, whole or not at all."""
    _atomic(path, json.dumps(payload, ensure_ascii=False, indent=2).encode())


def save_arrays(path: str, arrays: Mapping[str, np.ndarray]) -> None:
    """An ``.npz`` archive, whole or not at all."""
    import io

    out = io.BytesIO()
    np.savez(out, **arrays)
    _atomic(path, out.getvalue())


def _atomic(path: str, data: bytes) -> None:
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def save_documents(documents: DataFrame, path: str) -> None:
    """``content`` of each row as a line of text files."""
    documents.select("content").write.mode("errorifexists").text(path)


def save_table(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """Parquet, replacing only the partitions that ``rows`` has; the committer publishes whole files."""
    writer = rows.write.mode("overwrite")
    if partition:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition)
    writer.parquet(path)


def save_retrievals(nearest: DataFrame, metrics: DataFrame, folder: str) -> None:
    """``nearest`` as a table and the metrics as one document beside it."""
    save_table(nearest, f"{folder}/test_retrievals")
    save_json({f"R@{r['k']}": r["recall"] for r in metrics.collect()}, f"{folder}/final_metrics.json")
