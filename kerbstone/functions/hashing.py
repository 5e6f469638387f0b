"""Fingerprints of settings, rows and files."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def settings_fingerprint(settings: Mapping[str, Any]) -> str:
    """sha256 of the settings as JSON with sorted keys and no blanks."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def callable_identity(f: Any) -> dict[str, str]:
    """Module, name and source digest of a callable; one with state must give its own ``cache_identity``."""
    own = getattr(f, "cache_identity", None)
    if own is not None:
        return {"identity": json.dumps(own() if callable(own) else own, sort_keys=True)}
    if not inspect.isroutine(f) and not inspect.isclass(f) or getattr(f, "__closure__", None):
        raise ValueError(f"{f!r} has state and needs a cache_identity")
    return {"module": f.__module__, "name": f.__qualname__, "source": hashlib.sha256(inspect.getsource(f).encode()).hexdigest()}


def row_fingerprint(*columns: Column, settings: str = "") -> Column:
    """sha256 of the settings and the columns; a null differs from an empty text."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", F.lit(settings), *parts), 256)


def file_identities(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, size, modified, sha256`` of every file; identity is content, a touched file is the same."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def positives_digest(positives: Mapping[int, list[int]]) -> str:
    """sha256 over the map as JSON with keys sorted as text."""
    return hashlib.sha256(json.dumps({str(k): sorted(v) for k, v in positives.items()}, sort_keys=True).encode()).hexdigest()
