"""Importance, pins and recoverability of items, in single precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import IMPORTANCE, Config
from .text import f32, ratio32

# Weights and component values.
WEIGHTS = {
    "relevance": 0.15, "recency": 0.15, "dependency": 0.10, "unresolved": 0.20,
    "authority": 0.15, "uniqueness": 0.10, "recoverability_penalty": -0.10, "redundancy_penalty": -0.15,
}
RELEVANCE = {
    "SystemPrompt": 1.0, "DeveloperPrompt": 1.0, "Constraint": 1.0, "Decision": 1.0, "UserMessage": 0.95, "Error": 0.9, "AssistantMessage": 0.85,
    "ToolCall": 0.75, "Diff": 0.7, "Checkpoint": 0.6, "FileContent": 0.55, "TestResult": 0.4, "CommandOutput": 0.35, "ToolResult": 0.35, "Other": 0.3,
}
AUTHORITY = {"Constraint": 1.0, "SystemPrompt": 1.0, "DeveloperPrompt": 1.0, "UserMessage": 0.9}
DEDUPLICABLE = ("FileContent", "ToolResult", "CommandOutput", "TestResult", "Error", "AssistantMessage")
CONSTRAINT = r"\b(do not|don't|must not|never|always|must|avoid|only)\b"


def by_kind(values: dict[str, float], default: float) -> Column:
    out = f32(default)
    for kind, v in values.items():
        out = F.when(F.col("kind") == kind, f32(v)).otherwise(out)
    return out


def meta(name: str) -> Column:
    return F.col(f"metadata.{name}")


def flag(name: str) -> Column:
    return F.coalesce(meta(name), F.lit(False))


def unresolved() -> Column:
    return (F.col("state") == "Active") & ((F.col("kind") == "Error") | F.coalesce(meta("exit_code") != 0, F.lit(False)))


def looks_like_constraint() -> Column:
    return F.col("content").rlike("(?iU)" + CONSTRAINT)


def pinned(config: Config) -> Column:
    out = flag("pinned") | F.col("kind").isin("SystemPrompt", "DeveloperPrompt")
    if config.preservation.pin_user_constraints:
        out |= (F.col("kind") == "Constraint") | ((F.col("kind") == "UserMessage") & looks_like_constraint())
    if config.preservation.pin_unresolved_errors:
        out |= (F.col("kind") == "Error") & unresolved()
    return F.coalesce(out, F.lit(False))


def recoverability() -> Column:
    zero = F.col("kind").isin("UserMessage", "Constraint", "Decision", "SystemPrompt", "DeveloperPrompt")
    file = F.when(flag("recoverable") | meta("file_path").isNotNull(), f32(0.9)).otherwise(f32(0.5))
    tool = F.when(flag("recoverable") | meta("command").isNotNull(), f32(0.8)).otherwise(f32(0.4))
    out = F.when(F.col("kind") == "FileContent", file).when(F.col("kind").isin("ToolResult", "CommandOutput"), tool)
    return out.when(F.col("kind") == "Diff", f32(0.7)).when(zero, f32(0.0)).otherwise(f32(0.3))


def components() -> dict[str, Column]:
    """From columns idx, n_items, dup_count and is_canonical besides those of an item."""
    many = F.col("dup_count") > 1
    return {
        "relevance": by_kind(RELEVANCE, 0.3),
        "recency": ratio32(F.col("idx"), F.col("n_items")),
        "dependency": F.when(F.col("parent_id").isNotNull(), f32(0.8)).otherwise(f32(0.0)),
        "unresolved": F.when(unresolved(), f32(1.0)).otherwise(f32(0.0)),
        "authority": by_kind(AUTHORITY, 0.0),
        "uniqueness": F.when(~many, f32(1.0)).when(F.col("is_canonical"), f32(0.7)).otherwise(f32(0.1)),
        "recoverability_penalty": recoverability(),
        "redundancy_penalty": F.when(many, f32(1.0)).otherwise(f32(0.0)),
    }


def total() -> Column:
    """Weighted sum of the component columns, from left to right, clamped to [0, 1]."""
    out = None
    for name in IMPORTANCE:
        term = F.col(name) * f32(abs(WEIGHTS[name]))
        out = term if out is None else out + term if WEIGHTS[name] > 0 else out - term
    return F.greatest(F.least(out, f32(1.0)), f32(0.0))
