"""Settings: a frozen tree passed explicitly, from defaults, environment variables and given overrides, in that order."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Embedding:
    dimension: int = 256
    normalize: bool = True


@dataclass(frozen=True)
class Hybrid:
    weight_sem_score: float = 0.25
    weight_bm25_score: float = 0.20
    weight_token_overlap: float = 0.15
    weight_query_coverage: float = 0.20
    weight_shared_char: float = 0.10
    weight_exact_phrase: float = 0.10
    weight_keyword_hit: float = 0.05
    mode: str = "static"
    trees: int = 120
    depth: int = 4
    learning_rate: float = 0.08
    subsample: float = 0.9


@dataclass(frozen=True)
class LateInteraction:
    top_k_tokens: int = 128
    use_salience: bool = True
    quantization: str = "none"


@dataclass(frozen=True)
class Binary:
    hamming_top_k: int = 500
    bilinear_top_k: int = 50


@dataclass(frozen=True)
class Distilled:
    logistic_c: float = 1.0
    logistic_max_iter: int = 500
    full_tournament_max_docs: int = 50


@dataclass(frozen=True)
class Lsh:
    ngram: int = 3
    permutations: int = 128


@dataclass(frozen=True)
class Consistency:
    sim_threshold: float = 0.95
    value_tolerance: float = 0.01


@dataclass(frozen=True)
class Mining:
    contested_rank_gap: int = 50
    uncertainty_low: float = 0.4
    uncertainty_high: float = 0.6
    diversity_clusters: int = 10
    iterations: int = 3


@dataclass(frozen=True)
class Splits:
    train: float = 0.7
    validation: float = 0.15
    test: float = 0.15


@dataclass(frozen=True)
class Settings:
    embedding: Embedding = field(default_factory=Embedding)
    hybrid: Hybrid = field(default_factory=Hybrid)
    late_interaction: LateInteraction = field(default_factory=LateInteraction)
    binary: Binary = field(default_factory=Binary)
    distilled: Distilled = field(default_factory=Distilled)
    lsh: Lsh = field(default_factory=Lsh)
    consistency: Consistency = field(default_factory=Consistency)
    mining: Mining = field(default_factory=Mining)
    splits: Splits = field(default_factory=Splits)


def deep_merge(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def _typed(value: Any, like: Any) -> Any:
    if isinstance(like, bool):
        return value if isinstance(value, bool) else str(value).strip().lower() in {"1", "true", "yes", "on"}
    return type(like)(value)


def with_overrides(settings: Any, over: Mapping[str, Any]) -> Any:
    """The settings with values of a nested mapping; an unknown name is an error."""
    known = {f.name: getattr(settings, f.name) for f in fields(settings)}
    if unknown := set(over) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(settings, **{k: with_overrides(known[k], v) if is_dataclass(known[k]) else _typed(v, known[k]) for k, v in over.items()})


def from_environment(prefix: str = "RANKLOOM_", environment: Mapping[str, str] | None = None) -> Settings:
    """RANKLOOM_<SECTION>__<NAME>=value."""
    nested: dict[str, Any] = {}
    for key, value in (os.environ if environment is None else environment).items():
        if key.startswith(prefix) and "__" in key:
            section, name = key[len(prefix) :].lower().split("__", 1)
            nested.setdefault(section, {})[name] = value
    return with_overrides(Settings(), nested)


def from_yaml(path: str, settings: Settings | None = None) -> Settings:
    """The settings with those of a YAML file; an empty file changes nothing."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return with_overrides(settings or Settings(), yaml.safe_load(f) or {})


def sweep(base: Settings, variants: Mapping[str, Mapping[str, Any]]) -> dict[str, Settings]:
    """Named variants of the settings."""
    return {name: with_overrides(base, over) for name, over in variants.items()}
