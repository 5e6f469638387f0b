"""Named, replaceable parts of a pipeline."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

#: The kinds of parts.
KINDS = ("source", "encoder", "fusion", "graph_encoder", "dataset", "miner", "retriever", "metric")


def normalized(name: str) -> str:
    out = name.strip().lower().replace("-", "_")
    if not out:
        raise ValueError("a name must not be blank")
    return out


class Registry:
    """Parts by kind and name; a name is taken once unless it is replaced on purpose."""

    def __init__(self) -> None:
        self._parts: dict[str, dict[str, Any]] = {k: {} for k in KINDS}

    def _of(self, kind: str) -> dict[str, Any]:
        if kind not in self._parts:
            raise KeyError(f"no kind {kind!r}; one of {', '.join(KINDS)}")
        return self._parts[kind]

    def add(self, kind: str, name: str, part: Any, *, replace: bool = False) -> Any:
        known, name = self._of(kind), normalized(name)
        if name in known and not replace:
            raise ValueError(f"{kind} {name!r} exists; replace=True replaces it")
        known[name] = part
        return part

    def register(self, kind: str, name: str, *, replace: bool = False) -> Callable[[Any], Any]:
        return lambda part: self.add(kind, name, part, replace=replace)

    def get(self, kind: str, name: str) -> Any:
        known, name = self._of(kind), normalized(name)
        if name not in known:
            raise KeyError(f"no {kind} {name!r}; there are {', '.join(sorted(known)) or 'none'}")
        return known[name]

    def create(self, kind: str, name: str, /, *args: Any, **params: Any) -> Any:
        return self.get(kind, name)(*args, **params)

    def available(self, kind: str) -> list[str]:
        return sorted(self._of(kind))

    def contains(self, kind: str, name: str) -> bool:
        return normalized(name) in self._of(kind)


def default_registry() -> Registry:
    """The built-in parts."""
    from kerbstone.operators import encoder, retrieval, scene_graph, text_filters
    from kerbstone.sources import catalog

    r = Registry()
    r.add("source", "external_json", scene_graph.graph_files)
    r.add("encoder", "char_ngram", text_filters.ngram_vectors)
    r.add("fusion", "text_nodes", scene_graph.fused_edges)
    r.add("graph_encoder", "gat", encoder.encode_frames)
    r.add("dataset", "walk", catalog.indexed_frames)
    r.add("dataset", "drive", catalog.camera_frames)
    r.add("dataset", "ride", catalog.indexed_frames)
    r.add("miner", "hard_negative", retrieval.hard_negatives)
    r.add("miner", "random", retrieval.random_negatives)
    r.add("retriever", "cosine", retrieval.top_k)
    r.add("metric", "recall_at_k", retrieval.recall_at)
    return r
