"""Policies of compaction: defaults, overrides by model, and their checks."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstrand.functions.text import PRUNE_HEAD, PRUNE_MARKER, PRUNE_TAIL, PRUNE_THRESHOLD


@dataclass(frozen=True)
class Policy:
    """Ratios are shares of the context window; the rest are tokens or counts."""

    pressure_ratio: float = 0.80
    pressure_exit_ratio: float | None = None
    recent_ratio: float = 0.20
    forget_boundary_ratio: float = 0.50
    tool_maintenance_ratio: float = 0.40
    forget_maintenance_ratio: float = 0.70
    retain_tokens: int | None = None
    target_batch_tokens: int = 16_000
    max_batch_tokens: int = 24_000
    max_maintenance_batches: int = 1
    max_pressure_batches: int = 2
    min_reentry_turns: int = 1
    response_reserve_tokens: int = 8_192
    safety_margin_tokens: int = 2_048
    min_net_release_tokens: int = 1_024
    min_net_release_ratio: float = 0.15

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if value is None:
                continue
            if f.name.endswith("_ratio"):
                low = value >= 0 if f.name == "min_net_release_ratio" else value > 0
                if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or not low or value > 1:
                    raise ValueError(f"{f.name} must be a ratio")
            elif isinstance(value, bool) or not isinstance(value, int) or value < 0:
                raise ValueError(f"{f.name} must be a whole number from 0 on")
        if not self.recent_ratio < self.forget_boundary_ratio < self.forget_maintenance_ratio < self.pressure_ratio:
            raise ValueError("recent < forget boundary < forget maintenance < pressure must hold")
        if not self.forget_maintenance_ratio <= self.exit_ratio < self.pressure_ratio:
            raise ValueError("forget maintenance <= pressure exit < pressure must hold")
        if not self.recent_ratio <= self.tool_maintenance_ratio < self.forget_maintenance_ratio:
            raise ValueError("recent <= tool maintenance < forget maintenance must hold")
        if self.target_batch_tokens > self.max_batch_tokens:
            raise ValueError("a batch's target must not exceed its most")

    @property
    def exit_ratio(self) -> float:
        """Where a pressure pass may stop; at the maintenance line unless set."""
        return self.forget_maintenance_ratio if self.pressure_exit_ratio is None else self.pressure_exit_ratio


@dataclass(frozen=True)
class Spec:
    """A policy in tokens of one context window."""

    policy: Policy
    window: int
    threshold: int
    exit: int
    retain: int
    forget: int
    tool_line: int
    forget_line: int


def resolve(policy: Policy, window: int) -> Spec:
    """Thresholds of a window; windows so small that rounding or reserves leave no room are refused."""
    if isinstance(window, bool) or not isinstance(window, int) or window <= 0:
        raise ValueError("a context window must be a positive whole number")
    part = lambda ratio: math.floor(window * ratio)
    retain = part(policy.recent_ratio) if policy.retain_tokens is None else policy.retain_tokens
    spec = Spec(policy, window, part(policy.pressure_ratio), part(policy.exit_ratio), retain, part(policy.forget_boundary_ratio), part(policy.tool_maintenance_ratio), part(policy.forget_maintenance_ratio))
    if spec.retain >= min(spec.threshold, spec.forget):
        raise ValueError("what is retained must be less than the threshold and the forget boundary")
    if spec.exit >= spec.threshold:
        raise ValueError("the exit must be below the threshold")
    if policy.response_reserve_tokens + policy.safety_margin_tokens >= window:
        raise ValueError("reserve and margin must leave room in the window")
    return spec


def overridden(policy: Policy, **changes: object) -> Policy:
    """The policy with some fields changed, checked again; unknown names are errors."""
    return replace(policy, **changes)


def resolve_policies(targets: DataFrame, overrides: DataFrame, policy: Policy) -> DataFrame:
    """`targets` (provider, model, ...) with threshold and retain ratios: the model's override, else the policy's.

    Overrides are one row a model, so they are a dimension that Spark may broadcast by its own measure of their size.
    """
    rows = targets.join(overrides, ["provider", "model"], "left")
    return rows.withColumns({"pressure_ratio": F.coalesce("pressure_ratio", F.lit(policy.pressure_ratio)), "recent_ratio": F.coalesce("recent_ratio", F.lit(policy.recent_ratio))})


def duplicate_overrides(overrides: DataFrame) -> DataFrame:
    """(provider, model) that are overridden more than once, which is an error."""
    return overrides.groupBy("provider", "model").agg(F.count("*").alias("n")).where("n > 1").select("provider", "model")


#: The longest time that a timer can wait.
MOST_MILLISECONDS = 2**31 - 1


@dataclass(frozen=True)
class FoldConfig:
    """Limits of a fold; provider and model must be named, all else are whole numbers."""

    provider: str
    model: str
    min_events: int = 20
    max_events: int = 200
    max_input_bytes: int = 60_000
    max_output_tokens: int = 4_000
    timeout_ms: int = 120_000
    max_infra_retries: int = 2
    max_entries_per_kind: int = 50
    max_entry_bytes: int = 2_000
    max_list_items: int = 40

    def __post_init__(self) -> None:
        if not all(isinstance(x, str) and x for x in (self.provider, self.model)):
            raise ValueError("provider and model must be named")
        for f in fields(self)[2:]:
            value, least = getattr(self, f.name), 0 if f.name == "max_infra_retries" else 1
            if isinstance(value, bool) or not isinstance(value, int) or not least <= value < 2**53:
                raise ValueError(f"{f.name} must be a whole number from {least} on")
        if self.timeout_ms > MOST_MILLISECONDS:
            raise ValueError("timeout_ms is longer than a timer can wait")
        if self.max_events < self.min_events:
            raise ValueError("max_events must not be less than min_events")


def injection_budget(max_bytes: float, max_tokens: float | None = None) -> tuple[int, int]:
    """Bytes and tokens that a slot may take: whole numbers from 1 on, 512 tokens unless set."""
    return max(1, math.floor(max_bytes)), max(1, math.floor(512 if max_tokens is None else max_tokens))


def capped_group_tokens(most: int, cap: int | None) -> int:
    """The most tokens of a tool group, narrowed by what one auxiliary call can take in."""
    return most if cap is None else min(most, max(0, cap))


@dataclass(frozen=True)
class PruneConfig:
    """Budget of pruned texts in code points: head, marker and tail must fit into the threshold, and it into the hard limit of recent ones."""

    threshold: int = PRUNE_THRESHOLD
    head: int = PRUNE_HEAD
    tail: int = PRUNE_TAIL
    hard_limit: int | None = None

    def __post_init__(self) -> None:
        for name, least in (("threshold", 1), ("head", 0), ("tail", 0), ("hard_limit", 1)):
            value = getattr(self, name)
            if value is None and name == "hard_limit":
                continue
            if isinstance(value, bool) or not isinstance(value, int) or value < least:
                raise ValueError(f"{name} must be a whole number from {least} on")
        if self.head + len(PRUNE_MARKER) + self.tail > self.threshold:
            raise ValueError("head, marker and tail must fit into the threshold")
        if self.hard_limit is not None and self.hard_limit < self.threshold:
            raise ValueError("the hard limit must not be below the threshold")
