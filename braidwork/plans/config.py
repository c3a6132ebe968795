"""The locked protocol: validated settings, their hash, and their file."""

from __future__ import annotations

import hashlib
import json
from datetime import date
from pathlib import Path
from typing import Literal

import yaml
from pydantic import BaseModel, ConfigDict, Field, field_validator, model_validator

from ..operators.benchmark import BenchmarkSettings
from ..operators.consensus import ConsensusSettings
from ..operators.decision import Thresholds
from ..operators.overlap import Calibration


class _Strict(BaseModel):
    model_config = ConfigDict(extra="forbid")


# Field names and defaults are fixed values: the protocol hash depends on them.


class Query(_Strict):
    series_id: str = "target"
    keyword: str
    geo: str = ""
    category: int = 0
    search_property: Literal["web", "news", "images", "youtube", "froogle"] = "web"
    language: str = "en-US"
    historical_start: date
    historical_end: date
    topic_or_term: Literal["term", "topic"] = "term"
    baseline_start: date | None = None
    baseline_end: date | None = None

    @model_validator(mode="after")
    def _ordered(self):
        self.baseline_start = self.baseline_start or self.historical_start
        self.baseline_end = self.baseline_end or self.historical_end
        if not self.historical_start <= self.baseline_start <= self.baseline_end <= self.historical_end:
            raise ValueError("the baseline must be a period within the historical window")
        return self


class Design(_Strict):
    day_offsets: list[int] = Field(default_factory=lambda: [0, 1, 2, 7, 14, 21, 30])
    streams: list[str] = Field(default_factory=lambda: ["A", "B", "C"])
    technical_replicates: int = Field(1, ge=1)
    time_slots: list[str] = Field(default_factory=lambda: ["09:00", "13:00", "17:00"])
    random_seed: int = 20260727
    balance_stream_order: bool = True
    balance_chunk_order: bool = True
    require_fixed_environment_within_stream: bool = True

    @field_validator("day_offsets")
    @classmethod
    def _offsets(cls, value: list[int]) -> list[int]:
        if not value or min(value) < 0 or len(set(value)) < len(value):
            raise ValueError("day offsets must be distinct, not negative, and at least one")
        return sorted(value)

    @field_validator("streams")
    @classmethod
    def _streams(cls, value: list[str]) -> list[str]:
        if len(value) < 2 or len(set(value)) < len(value):
            raise ValueError("at least two distinct streams are required")
        return value


class Chunking(_Strict):
    window_days: int = Field(180, ge=30)
    step_days: int = Field(15, ge=1)
    min_overlap_days: int = Field(14, ge=2)
    inclusive_end: bool = True

    @model_validator(mode="after")
    def _steps(self):
        if self.step_days >= self.window_days:
            raise ValueError("the step must be smaller than the window")
        return self


class CalibrationConfig(_Strict):
    min_value: float = 2.0
    huber_c: float = 1.345
    max_huber_iter: int = 100
    huber_tol: float = 1e-8
    edge_variance_floor: float = 1e-6
    max_edge_weight: float = 1e6
    reference_strategy: Literal["highest_degree", "first", "explicit"] = "highest_degree"
    explicit_reference_chunk: str | None = None
    lognormal_bias_correction: bool = True
    aggregation: Literal["inverse_variance", "median", "huber"] = "inverse_variance"
    normalization: Literal["baseline_mean_100", "max_100", "none"] = "baseline_mean_100"
    allow_disconnected: bool = False

    @model_validator(mode="after")
    def _reference(self):
        if self.reference_strategy == "explicit" and not self.explicit_reference_chunk:
            raise ValueError("an explicit reference needs its chunk id")
        return self


class Duplicates(_Strict):
    hash_decimals: int = 10
    exact_tolerance: float = 1e-10
    min_pair_observations: int = 30
    raw_correlation_threshold: float = 0.995
    residual_correlation_threshold: float = 0.95
    exact_cell_agreement_threshold: float = 0.90
    mae_100_threshold: float = 0.02
    positive_jaccard_threshold: float = 0.90
    use_residual_rule: bool = True


class ConsensusConfig(_Strict):
    collapse_exact_duplicates: bool = True
    center_pull_bias: bool = False
    covariance: Literal["ledoit_wolf", "empirical", "diagonal"] = "ledoit_wolf"
    nonnegative_weights: bool = True
    weight_cap: float | None = Field(0.5, gt=0, le=1)
    local_uncertainty: bool = True
    baseline_rescale: bool = True


class GStudy(_Strict):
    clip_negative_components: bool = True
    bootstrap_replications: int = 0
    block_length: int = 28
    random_seed: int = 20260727
    transformations: list[Literal["level", "detection", "innovation"]] = Field(default_factory=lambda: ["level", "detection", "innovation"])


class Benchmark(_Strict):
    enabled: bool = True
    mode: Literal["soft", "exact"] = "soft"
    fidelity_weight: float = 1.0
    smoothness_weight: float = 10.0
    ridge: float = 1e-8
    default_benchmark_se: float = 2.0
    preserve_nonnegative: bool = True


class Decision(_Strict):
    min_unique_pulls: int = 12
    min_spectral_effective_pulls: float = 4.0
    max_zero_share: float = 0.80
    min_level_generalizability: float = 0.80
    min_innovation_generalizability: float = 0.70
    min_detection_kappa: float = 0.60
    max_component_share: float = 0.50
    max_convergence_mae_100: float = 0.02
    max_benchmark_standardized_rmse: float = 1.50
    require_connected_overlap_graphs: bool = True
    require_protocol_integrity: bool = True


class Protocol(_Strict):
    """All settings of a batch."""

    query: Query
    design: Design = Field(default_factory=Design)
    chunking: Chunking = Field(default_factory=Chunking)
    calibration: CalibrationConfig = Field(default_factory=CalibrationConfig)
    duplicates: Duplicates = Field(default_factory=Duplicates)
    consensus: ConsensusConfig = Field(default_factory=ConsensusConfig)
    gstudy: GStudy = Field(default_factory=GStudy)
    benchmark: Benchmark = Field(default_factory=Benchmark)
    decision: Decision = Field(default_factory=Decision)

    def canonical(self) -> dict:
        return self.model_dump(mode="json", exclude_none=False)

    def protocol_hash(self) -> str:
        """SHA-256 of the settings as JSON with sorted keys and no spaces."""
        return hashlib.sha256(json.dumps(self.canonical(), ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def save(self, path: str | Path) -> None:
        body = {"protocol_hash": self.protocol_hash(), **self.canonical()}
        Path(path).write_text(yaml.safe_dump(body, sort_keys=False, allow_unicode=True), encoding="utf-8")

    @classmethod
    def load(cls, path: str | Path) -> "Protocol":
        """Read settings; a hash in the file must be theirs."""
        body = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
        stated = body.pop("protocol_hash", None)
        found = cls.model_validate(body)
        if stated is not None and stated != found.protocol_hash():
            raise ValueError("the file's protocol hash is not that of its settings")
        return found

    def calibration_settings(self) -> Calibration:
        c = self.calibration
        return Calibration(
            c.min_value, self.chunking.min_overlap_days, c.huber_c, c.max_huber_iter, c.huber_tol, c.edge_variance_floor, c.max_edge_weight, c.reference_strategy,
            c.explicit_reference_chunk, c.lognormal_bias_correction, c.aggregation, c.normalization, c.allow_disconnected,
        )

    def consensus_settings(self) -> ConsensusSettings:
        c = self.consensus
        return ConsensusSettings(
            c.collapse_exact_duplicates, c.center_pull_bias, c.covariance, c.nonnegative_weights, c.weight_cap, c.local_uncertainty, c.baseline_rescale,
            str(self.query.baseline_start), str(self.query.baseline_end),
        )

    def benchmark_settings(self) -> BenchmarkSettings:
        b = self.benchmark
        return BenchmarkSettings(b.mode, b.fidelity_weight, b.smoothness_weight, b.ridge, b.default_benchmark_se, b.preserve_nonnegative)

    def thresholds(self) -> Thresholds:
        return Thresholds(*self.decision.model_dump().values())
