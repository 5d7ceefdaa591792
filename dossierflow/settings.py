"""Run settings, with environment overrides for prompts, model and limits."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from dossierflow.functions.prompts import default_prompt
from dossierflow.operators.rules import (
    DEFAULT_LEXICON,
    ENTITY_RULES,
    PII_RULES,
    Lexicon,
    PiiRule,
    Rule,
)

PREFIX = "DOSSIERFLOW_"


@dataclass(frozen=True)
class Settings:
    """Everything a run can be told; ``from_env`` reads ``DOSSIERFLOW_*`` overrides."""

    catalog: str = "catalog"
    schema: str = "schema"
    volume: str = "volume"
    model: str = "rules"
    temperature: float = 0.0
    max_tokens: int = 5000
    max_file_bytes: int = 100 * 1024 * 1024
    enforce_file_limits: bool = False
    prompts: dict[str, str] = field(
        default_factory=lambda: {s: default_prompt(s) for s in ("categorize", "extract", "deidentify")}
    )
    entity_rules: tuple[Rule, ...] = ENTITY_RULES
    pii_rules: tuple[PiiRule, ...] = PII_RULES
    # a Lexicon lives in the plan; a table (category, term, weight) is joined
    lexicon: Lexicon | DataFrame = DEFAULT_LEXICON
    force_fail_stage: str | None = None
    # Reported outcome when a model stage fails: False reports the failure, True
    # lets the run end as completed with empty results.
    hide_stage_errors: bool = False
    strip_reply_fences: bool = False
    scorers: dict[str, Callable] = field(default_factory=dict)
    # a model sees a whole document in windows of so many characters, which overlap
    prompt_chars: int = 5000
    prompt_overlap: int = 500
    logs_path: str = "/Volumes/catalog/schema/volume/logs"
    table_rows: int = 20

    @classmethod
    def from_env(cls, environ: dict[str, str] | None = None, **overrides) -> "Settings":
        env = os.environ if environ is None else environ
        values: dict = {}
        prompts = {s: env.get(f"{PREFIX}{s.upper()}_PROMPT") or default_prompt(s)
                   for s in ("categorize", "extract", "deidentify")}
        values["prompts"] = prompts
        for key, cast in (
            ("catalog", str), ("schema", str), ("volume", str), ("model", str),
            ("temperature", float), ("max_tokens", int), ("force_fail_stage", str),
            ("logs_path", str), ("table_rows", int),
        ):
            raw = env.get(PREFIX + key.upper())
            if raw:
                values[key] = cast(raw)
        if env.get(PREFIX + "MAX_FILE_MB"):
            values["max_file_bytes"] = int(env[PREFIX + "MAX_FILE_MB"]) * 1024 * 1024
        values.update(overrides)
        return cls(**values)
