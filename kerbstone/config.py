"""Strict settings of a pipeline: unknown keys, wrong types and contradictions are refused."""

from __future__ import annotations

import dataclasses
import math
import types
import typing
from dataclasses import dataclass, field
from typing import Any

from kerbstone.operators.incremental import POLICIES
from kerbstone.operators.scene_graph import STRATEGIES


#: How training, validation and test are kept from sharing ground truth.
GUARDS = ("", "none", "ground_truth_overlap", "ground_truth_blocks")


class ConfigError(ValueError):
    """Settings that can't be used; the message names the key."""


@dataclass(frozen=True)
class Dataset:
    adapter: str = "walk"
    sequences: list[str] = field(default_factory=lambda: ["seq1", "seq2"])
    reference_sequence: str = "seq1"
    query_sequence: str = "seq2"
    test_ratio: float = 0.2
    validation_ratio: float = 0.1
    validation_centres: list[float] = field(default_factory=list)
    split_guard: str = ""
    split_fold: int = -1
    split_fold_count: int = 0
    gt_radius_m: float = 25.0
    gt_dimensions: int = 0
    interpolate_gt: bool = False
    primary_camera: str = "walk"
    camera_fold_max_gap_s: float = 0.3


@dataclass(frozen=True)
class Preprocess:
    text_encoder: str = "char_ngram"
    text_dim: int = 64
    shuffle_text_seed: int | None = None
    use_text_nodes: bool = True
    connection_strategy: str = "overlap_nearest"
    connection_k: int = 1
    text_min_length: int = 3
    text_drop_numeric: bool = True
    dynamic_text_threshold: float | None = 0.5
    dynamic_node_classes: list[str] = field(default_factory=list)
    gt_tolerance_ns: int = 50_000_000


@dataclass(frozen=True)
class Model:
    backend: str = "gat"
    hidden_dim: int = 256
    n_layers: int = 1
    proj_dim: int = 256
    heads: int = 4
    text_fusion: str = "set"
    use_edge_geometry: bool = True


@dataclass(frozen=True)
class Training:
    negatives_per_query: int = 2
    hard_search_depth: int = 256
    negative_min_distance_m: float = 0.0
    positive_max_distance_m: float = 0.0
    positive_interval_fraction: float = 0.0
    miner: str = "hard_negative"
    same_camera_triplets: bool = False
    recall_values: list[int] = field(default_factory=lambda: [1, 5, 10])


@dataclass(frozen=True)
class Retrieval:
    backend: str = "cosine"
    metric: str = "recall_at_k"
    top_k: int = 20
    rerank_depth: int = 0
    rerank_frames: int = 1


@dataclass(frozen=True)
class Settings:
    dataset: Dataset = field(default_factory=Dataset)
    preprocess: Preprocess = field(default_factory=Preprocess)
    model: Model = field(default_factory=Model)
    training: Training = field(default_factory=Training)
    retrieval: Retrieval = field(default_factory=Retrieval)
    cache_policy: str = POLICIES[0]
    seed: int = 42


def _value(kind: Any, value: Any, at: str) -> Any:
    if dataclasses.is_dataclass(kind):
        return _section(kind, value, at)
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin is types.UnionType:
        return None if value is None else _value(next(a for a in args if a is not type(None)), value, at)
    if origin is list:
        if not isinstance(value, list):
            raise ConfigError(f"{at} must be a list")
        return [_value(args[0], v, f"{at}[{i}]") for i, v in enumerate(value)]
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        value = float(value)
    if type(value) is not kind:
        raise ConfigError(f"{at} must be {kind.__name__}, not {type(value).__name__}")
    if kind is float and not math.isfinite(value):
        raise ConfigError(f"{at} must be finite")
    return value


def _section(kind: Any, payload: Any, at: str) -> Any:
    if not isinstance(payload, dict):
        raise ConfigError(f"{at or 'the settings'} must be a mapping")
    hints = typing.get_type_hints(kind)
    unknown = [k for k in payload if k not in hints]
    if unknown:
        raise ConfigError(f"unknown key {'.'.join(x for x in (at, str(unknown[0])) if x)}")
    return kind(**{k: _value(hints[k], v, ".".join(x for x in (at, k) if x)) for k, v in payload.items()})


def settings_from(payload: dict[str, Any]) -> Settings:
    """Settings of a nested mapping, checked against each other and the registry."""
    from kerbstone.registry import default_registry

    s = _section(Settings, payload, "")
    d, p, t, r = s.dataset, s.preprocess, s.training, s.retrieval
    parts = default_registry()
    checks = [
        (0 < d.test_ratio < 1 and 0 <= d.validation_ratio < 1 and d.test_ratio + d.validation_ratio < 1, "test_ratio and validation_ratio must leave queries for training"),
        (d.reference_sequence != d.query_sequence, "the reference and the query sequence must differ"),
        (d.split_guard in GUARDS, f"split_guard must be one of {', '.join(GUARDS[1:])} or empty"),
        ((d.split_guard == "ground_truth_blocks") == bool(d.validation_centres), "split_guard ground_truth_blocks and validation_centres go together"),
        (d.gt_radius_m > 0, "gt_radius_m must be positive"),
        (d.split_fold_count == 0 or 3 <= d.split_fold_count and 0 <= d.split_fold < d.split_fold_count, "split_fold must be one of three folds or more"),
        (p.connection_strategy in STRATEGIES, f"connection_strategy must be one of {', '.join(STRATEGIES)}"),
        (parts.contains("encoder", p.text_encoder), f"no encoder {p.text_encoder!r}"),
        (parts.contains("graph_encoder", s.model.backend), f"no graph_encoder {s.model.backend!r}"),
        (parts.contains("miner", t.miner), f"no miner {t.miner!r}"),
        (parts.contains("retriever", r.backend), f"no retriever {r.backend!r}"),
        (parts.contains("metric", r.metric), f"no metric {r.metric!r}"),
        (t.recall_values == sorted({*t.recall_values}) and min(t.recall_values, default=0) > 0, "recall_values must be positive, sorted and unique"),
        ((t.positive_max_distance_m > 0) + (t.positive_interval_fraction > 0) < 2, "positive_max_distance_m and positive_interval_fraction exclude each other"),
        (s.cache_policy in POLICIES, f"cache_policy must be one of {', '.join(POLICIES)}"),
    ]
    for good, message in checks:
        if not good:
            raise ConfigError(message)
    return s


def load_settings(path: str) -> Settings:
    """Settings of a YAML file."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return settings_from(yaml.safe_load(f) or {})


def dump_settings(s: Settings, path: str) -> None:
    """YAML in the order of declaration."""
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(dataclasses.asdict(s), f, sort_keys=False, allow_unicode=True)
