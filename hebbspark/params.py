"""Parameters, their defaults and ranges, and the JSON configuration."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


class ConfigError(ValueError):
    """A parameter is unknown or outside its range."""


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


def _whole(x, low: int, high: int, what: str) -> None:
    _need(isinstance(x, int) and not isinstance(x, bool) and low <= x <= high, f"{what} must be a whole number from {low} to {high}")


def _number(x, low: float, high: float, what: str) -> None:
    _need(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) and low <= x <= high, f"{what} must be from {low} to {high}")


@dataclass(frozen=True)
class EdgeParams:
    """Decay rate per tick, gain per reinforcement, and the weight below which an edge is dead."""

    lam: float = 0.05
    eta: float = 1.0
    floor: float = 1e-3

    def __post_init__(self):
        _need(all(math.isfinite(x) for x in (self.lam, self.eta, self.floor)), "edge parameters must be finite")
        _need(self.eta >= 0 and 0 < self.floor < 1, "eta must not be negative and floor must be between 0 and 1")


@dataclass(frozen=True)
class SearchParams:
    budget: int = 16
    hops: int = 2
    seeds: int = 8
    graph_weight: float = 0.4
    cutoff: float = 1e-3

    def __post_init__(self):
        _whole(self.hops, 0, 8, "hops")
        _number(self.graph_weight, 0, 100, "graph_weight")


# Sections, defaults and ranges of the configuration.
DEFAULTS = {
    "storage": {"path": "memory", "max_database_bytes": 64 << 20, "max_checkpoint_bytes": 64 << 20},
    "limits": {"max_nodes": 10_000, "max_text_bytes": 16 << 20, "max_record_bytes": 16 << 10, "max_request_bytes": 64 << 10},
    "graph": {"lambda": 0.05, "eta": 1.0, "floor": 1e-3, "edge_policy": "star", "initial_capacity": 8192, "max_capacity": 262_144, "allow_growth": True},
    "retention": {"overflow": "reject", "ttl_ticks": 0},
    "retrieval": {"default_limit": 8, "max_limit": 64, "max_context_bytes": 12_000, "hops": 2, "graph_weight": 0.4},
}
PRODUCT = {"graph": {"lambda": 0.0, "edge_policy": "adjacent"}}
POLICIES = ("star", "combined", "adjacent")


@dataclass(frozen=True)
class MemoryConfig:
    """A validated configuration; unknown sections and fields are errors."""

    sections: dict = field(default_factory=dict)

    def __post_init__(self):
        _need(isinstance(self.sections, dict), "the configuration must be an object")
        _need(set(self.sections) <= set(DEFAULTS) | {"version"}, "unknown section")
        _need(self.sections.get("version", 1) == 1, "unknown version")
        for name, own in self.sections.items():
            if name != "version":
                _need(isinstance(own, dict) and set(own) <= set(DEFAULTS[name]), f"unknown field in {name}")
        limits, graph, keep, find, store = (self[n] for n in ("limits", "graph", "retention", "retrieval", "storage"))
        for key, low, high in (("max_nodes", 1, 1_000_000), ("max_text_bytes", 1, 1 << 40), ("max_record_bytes", 1, 1 << 24), ("max_request_bytes", 1024, 1 << 25)):
            _whole(limits[key], low, high, key)
        _need(limits["max_record_bytes"] <= limits["max_text_bytes"], "a record may not exceed the text quota")
        _need(isinstance(store["path"], str) and store["path"].strip() not in ("", ":memory:"), "storage.path must name a folder")
        for key in ("max_database_bytes", "max_checkpoint_bytes"):
            _whole(store[key], 65_536, 1 << 40, key)
        _number(graph["lambda"], 0, 1, "lambda")
        _number(graph["eta"], 0, 1e6, "eta")
        _number(graph["floor"], 1e-12, 1, "floor")
        _need(graph["edge_policy"] in POLICIES, "unknown edge policy")
        for key in ("initial_capacity", "max_capacity"):
            _whole(graph[key], 2, 1 << 26, key)
            _need(graph[key] & (graph[key] - 1) == 0, f"{key} must be a power of two")
        _need(graph["initial_capacity"] <= graph["max_capacity"], "initial_capacity exceeds max_capacity")
        _need(isinstance(graph["allow_growth"], bool), "allow_growth must be true or false")
        _need(keep["overflow"] in ("reject", "oldest"), "unknown overflow rule")
        _whole(keep["ttl_ticks"], 0, (1 << 32) - 1, "ttl_ticks")
        _whole(find["max_limit"], 1, 64, "max_limit")
        _whole(find["default_limit"], 1, 64, "default_limit")
        _need(find["default_limit"] <= find["max_limit"], "default_limit exceeds max_limit")
        _whole(find["max_context_bytes"], 2, 1 << 24, "max_context_bytes")
        _whole(find["hops"], 0, 8, "hops")
        _number(find["graph_weight"], 0, 100, "graph_weight")

    def __getitem__(self, section: str) -> dict:
        return {**DEFAULTS[section], **self.sections.get(section, {})}

    @classmethod
    def load(cls, path: str | Path) -> MemoryConfig:
        """Read a file; a relative storage path is taken from the file's folder."""
        path = Path(path)
        try:
            sections = json.loads(path.read_text(encoding="utf-8"))
        except (OSError, ValueError) as e:
            raise ConfigError(str(e)) from e
        config = cls(sections)
        place = Path(config["storage"]["path"])
        if not place.is_absolute():
            sections = {**sections, "storage": {**sections.get("storage", {}), "path": str(path.parent / place)}}
        return cls(sections)

    @property
    def edges(self) -> EdgeParams:
        g = self["graph"]
        return EdgeParams(g["lambda"], g["eta"], g["floor"])

    def learning(self) -> str:
        """What may not change during the life of a memory: decay, gain and floor."""
        return json.dumps([float(self["graph"][k]) for k in ("lambda", "eta", "floor")])

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps({n: self[n] for n in DEFAULTS}, sort_keys=True).encode()).hexdigest()


def as_dict(p) -> dict:
    return {f.name: asdict(p)[f.name] for f in fields(p)}


def edge_table_capacity(nodes: int) -> int:
    """The smallest power of two that holds all pairs of ``nodes`` at 70 % load."""
    pairs, size = nodes * (nodes - 1) // 2, 2
    while size * 7 // 10 < pairs:
        size *= 2
    return size
