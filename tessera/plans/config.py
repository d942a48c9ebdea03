"""Tunables with their defaults and bounds."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Defaults of the search, evidence, analytics, vector and ingest stages.
    default_limit: int = 10
    max_limit: int = 50
    bm25_top_k: int = 1_000
    vector_top_k: int = 200
    ltr_top_k: int = 100
    rerank_top_k: int = 20
    max_per_domain: int = 3
    rrf_k: int = 60
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    title_boost: float = 2.0
    containment_tau: float = 0.3
    answer_passage_cap: int = 8
    answer_abstain_threshold: float = 0.0
    answer_corroboration_tau: float = 3.0
    deep_fetch_max: int = 2
    compare_noise_floor_p90: float = 0.30
    compare_jitter_ms_max: int = 30_000
    pull_interval_secs: int = 900
    retention_days: int = 90
    max_edges: int = 200_000
    ingest_batch_max: int = 100
    snippet_max_chars: int = 240
    bandit_epsilon: float = 0.1
    decision_retention_days: int = 30
    decision_max_bytes: int = 20 * 1024 * 1024
    schema_version: int = 3

    def dump(self) -> dict[str, object]:
        return dataclasses.asdict(self)


#: Knobs a request may override, with their least and greatest values.
KNOBS: dict[str, tuple[float, float]] = {
    "bm25_top_k": (1, 5000),
    "vector_top_k": (1, 1000),
    "max_per_domain": (1, 50),
    "searx_deadline_ms": (100, 4000),
    "deep_fetch_max": (0, 8),
    "deep_fetch_deadline_ms": (200, 4000),
    "answer_deadline_ms": (200, 4000),
    "answer_passage_cap": (1, 32),
    "answer_abstain_threshold": (-20, 20),
    "answer_corroboration_tau": (-20, 20),
    "compare_jitter_ms_max": (0, 60000),
    "compare_noise_floor_p90": (0, 1),
    "rrf_k": (1, 1000),
    "containment_tau": (0.05, 0.95),
    "rerank_deadline_ms": (200, 4000),
    "answer_passage_deadline_ms": (200, 3000),
    "answer_corroboration_deadline_ms": (100, 2000),
}


def clamp(name: str, value: float) -> float:
    low, high = KNOBS[name]
    return min(max(value, low), high)


def with_overrides(config: Config, overrides: dict[str, float]) -> tuple[Config, dict[str, float]]:
    """The configuration with clamped overrides, and those that changed something, for the response's echo."""
    echo, known = {}, {f.name: f.type for f in dataclasses.fields(config)}
    for name, value in overrides.items():
        v = clamp(name, value)
        echo[name] = v
        if name in known:
            config = dataclasses.replace(config, **{name: int(v) if known[name] == "int" else float(v)})
    return config, {k: v for k, v in echo.items() if k not in known or overrides.get(k) is not None}


class InvalidRequest(ValueError):
    """A request whose parameters contradict each other (status 400)."""


def validate(scope: str = "both", mode: str = "fast", lane: str | None = None, budget: int = 0, answer: bool = False, compare: bool = False, filtered: bool = False) -> list[str]:
    """Rules across parameters; returns the degradation flags that the request starts with."""
    if scope not in ("local", "web", "both") or mode not in ("fast", "deep"):
        raise InvalidRequest("unknown scope or mode")
    if budget and (mode != "deep" or lane not in (None, "direct") or compare):
        raise InvalidRequest("a fetch budget needs deep mode on the direct lane, without compare")
    if answer and not budget:
        raise InvalidRequest("answer needs a fetch budget")
    if compare and (scope == "local" or lane is not None):
        raise InvalidRequest("compare needs the web and picks its own lanes")
    if filtered and scope == "web":
        raise InvalidRequest("filters apply to local documents only")
    return ["geo_web_unfiltered"] if filtered and scope == "both" else []
