"""Schemas, enumerations and configuration."""

from __future__ import annotations

import math
import os
import tomllib
from dataclasses import dataclass, field, fields, replace

# Spellings of the wire format and the tables.
KINDS = (
    "SystemPrompt", "DeveloperPrompt", "UserMessage", "AssistantMessage", "ToolCall", "ToolResult", "FileContent", "CommandOutput",
    "Error", "Decision", "Constraint", "Checkpoint", "Diff", "TestResult", "Other",
)
SLUGS = (
    "system", "developer", "user", "assistant", "tool-call", "tool-result", "file", "command-output",
    "error", "decision", "constraint", "checkpoint", "diff", "test-result", "other",
)
STATES = ("Active", "Resolved", "Superseded", "Abandoned", "Unknown")
LEVELS = ("L0", "L1", "L2", "L3", "L4", "L5")
ACTIONS = ("Keep", "Deduplicate", "Reduce", "Extract", "Summarize", "Externalize", "Evict", "Pin")
PRESSURES = ("Green", "Observe", "Trim", "Compact", "Aggressive", "Emergency")

METADATA = "file_path STRING, command STRING, exit_code INT, tool_name STRING, artifact_ref STRING, recoverable BOOLEAN, pinned BOOLEAN, tags ARRAY<STRING>"
_METADATA_TYPE = "STRUCT<" + ", ".join(f"{n}: {t}" for n, t in (p.split(" ", 1) for p in METADATA.split(", "))) + ">"
#: What a JSON record may hold.
WIRE = f"id STRING, parent_id STRING, kind STRING, content STRING, token_count BIGINT, created_at STRING, source STRING, metadata {_METADATA_TYPE}, state STRING, compression_level STRING, content_hash STRING"
ITEMS = (
    f"session_id STRING, item_id STRING, parent_id STRING, kind STRING, content STRING, content_hash STRING, token_count BIGINT, created_at TIMESTAMP, "
    f"source STRUCT<type: STRING, adapter: STRING>, metadata {_METADATA_TYPE}, state STRING, compression_level STRING"
)
IMPORTANCE = ("relevance", "recency", "dependency", "unresolved", "authority", "uniqueness", "recoverability_penalty", "redundancy_penalty")
TABLES = {
    "context_items": ITEMS,
    "events": "event_id BIGINT, session_id STRING, type STRING, payload_json STRING, created_at TIMESTAMP",
    "sessions": "session_id STRING, config_json STRING, created_at TIMESTAMP",
    "artifacts": "session_id STRING, artifact_id STRING, item_id STRING, content STRING, created_at TIMESTAMP",
    "compaction_runs": "run_id STRING, session_id STRING, before_tokens BIGINT, after_tokens BIGINT, pressure_state STRING, created_at TIMESTAMP",
    "compaction_actions": "run_id STRING, session_id STRING, item_id STRING, action STRING, from_level STRING, to_level STRING, estimated_before BIGINT, estimated_after BIGINT, "
    "importance STRUCT<" + ", ".join(f"{c}: FLOAT" for c in ("total", *IMPORTANCE)) + ">, reason STRING",
    "token_stats": "session_id STRING, event_type STRING, ema FLOAT, count BIGINT",
    "working_set_meta": "session_id STRING, materialized_at TIMESTAMP, version BIGINT, last_event BIGINT, run_id STRING",
    "working_set_actions": "session_id STRING, version BIGINT, pos INT, item_id STRING, action STRING, to_level STRING",
    "working_set_items": "session_id STRING, pos INT, item_id STRING, parent_id STRING, kind STRING, content STRING, token_count BIGINT, compression_level STRING, artifact_ref STRING, version BIGINT",
    "item_totals": "session_id STRING, kind STRING, state STRING, items BIGINT, tokens BIGINT",
    "memory_items": "session_id STRING, key STRING, item_id STRING, content STRING, length BIGINT, block INT",
    "memory_postings": "session_id STRING, term STRING, key STRING, block INT, length BIGINT, tf BIGINT",
}
CHECKPOINT = (
    "goal STRING, status STRING, summary STRING, decisions ARRAY<STRUCT<decision: STRING, rationale: STRING>>, "
    "modified_files ARRAY<STRUCT<path: STRING, change: STRING, artifact_ref: STRING>>, commands ARRAY<STRUCT<command: STRING, exit_code: INT, summary: STRING>>, "
    "validation ARRAY<STRUCT<name: STRING, passed: BOOLEAN, details: STRING>>, unresolved ARRAY<STRING>, artifact_refs ARRAY<STRING>"
)


class ConfigError(ValueError):
    """A configuration that breaks a rule."""


@dataclass(frozen=True)
class Context:
    max_context_window: int = 200_000
    target_pressure: float = 0.55
    observe: float = 0.45
    trim: float = 0.60
    compact: float = 0.72
    aggressive: float = 0.82
    emergency: float = 0.90


@dataclass(frozen=True)
class Reserve:
    output_tokens: int = 16_000
    safety_tokens: int = 12_000


@dataclass(frozen=True)
class Preservation:
    recent_tokens: int = 24_000
    pin_user_constraints: bool = True
    pin_unresolved_errors: bool = True


@dataclass(frozen=True)
class Tools:
    deduplicate: bool = True
    reduce_logs: bool = True
    externalize_large_results: bool = True
    large_result_tokens: int = 6_000


@dataclass(frozen=True)
class Prediction:
    enabled: bool = True
    ema_alpha: float = 0.25


@dataclass(frozen=True)
class Semantic:
    enabled: bool = False


@dataclass(frozen=True)
class Config:
    """importance_protects: divide savings by importance itself rather than by what is left of it to 1 (see README)."""

    context: Context = field(default_factory=Context)
    reserve: Reserve = field(default_factory=Reserve)
    preservation: Preservation = field(default_factory=Preservation)
    tools: Tools = field(default_factory=Tools)
    prediction: Prediction = field(default_factory=Prediction)
    semantic: Semantic = field(default_factory=Semantic)
    memory: dict = field(default_factory=lambda: {"backend": "none"})
    importance_protects: bool = False

    def validate(self) -> Config:
        c = self.context
        marks = [c.observe, c.trim, c.compact, c.aggressive, c.emergency]
        if any(not (0 <= x <= 1) for x in marks) or marks != sorted(marks):
            raise ConfigError("pressure thresholds must lie in [0, 1] and not decrease")
        for name, x in (("target_pressure", c.target_pressure), ("ema_alpha", self.prediction.ema_alpha)):
            if not math.isfinite(x) or not 0 <= x <= 1:
                raise ConfigError(f"{name} must be finite and in [0, 1]")
        if self.reserve.output_tokens + self.reserve.safety_tokens >= c.max_context_window:
            raise ConfigError("reserves must leave room in the context window")
        return self

    @staticmethod
    def from_dict(raw: dict) -> Config:
        """From parsed TOML; missing keys take defaults, unknown ones are ignored, ``<threshold>_pressure`` is an alias."""
        out = Config()
        for part in fields(Config):
            given = raw.get(part.name)
            if not isinstance(given, dict) or part.name == "memory":
                if part.name == "memory" and isinstance(given, dict):
                    out = replace(out, memory={**out.memory, **given})
                continue
            section = getattr(out, part.name)
            known = {f.name for f in fields(section)}
            given = {k if k in known else k.removesuffix("_pressure"): v for k, v in given.items()}
            out = replace(out, **{part.name: replace(section, **{k: v for k, v in given.items() if k in known})})
        return out.validate()


def load_config(path: str | None = None) -> Config:
    """The file given, or named by SESSIONLOOM_CONFIG, or defaults."""
    path = path or os.environ.get("SESSIONLOOM_CONFIG")
    if not path:
        return Config().validate()
    with open(path, "rb") as f:
        return Config.from_dict(tomllib.load(f))


@dataclass(frozen=True)
class Model:
    """A model's name, window and reserve; the reserve falls back to the configuration's."""

    name: str = "generic"
    context_window: int = 200_000
    reserved_output_tokens: int = 16_000

    def check(self, config: Config) -> Model:
        if not self.context_window or self.context_window <= self.reserved_output_tokens + config.reserve.safety_tokens:
            raise ConfigError("the model's window must exceed its reserves")
        return self

    @staticmethod
    def default(config: Config) -> Model:
        return Model("generic", config.context.max_context_window, config.reserve.output_tokens)
