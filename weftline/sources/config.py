"""Settings from YAML or JSON files, with ${NAME} substitution and nested sections flattened. Driver side."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields
from pathlib import Path

from weftline.functions.values import EXCLUDE


@dataclass
class Settings:
    project_path: str = "."
    memory_dir: str = ".weftline"
    max_analysis_depth: int = 3
    exclude_patterns: list[str] = field(default_factory=lambda: list(EXCLUDE))
    llm_model: str = ""
    llm_mode: str = "agent"
    n_consistency: int = 1
    max_parallel: int = 2
    batch_size: int = 10
    parallel: bool = True


def substituted(value):
    """${NAME} as a whole string becomes the environment's value (empty if unset), at any depth."""
    if isinstance(value, dict):
        return {k: substituted(v) for k, v in value.items()}
    if isinstance(value, list):
        return [substituted(v) for v in value]
    if isinstance(value, str) and (m := re.fullmatch(r"\$\{(\w+)\}", value)):
        return os.environ.get(m[1], "")
    return value


def flattened(config: dict) -> dict:
    """section: {key: value} becomes section_key where that is a setting, else key."""
    known, out = {f.name for f in fields(Settings)}, {}
    for key, value in config.items():
        if isinstance(value, dict):
            out |= {(f"{key}_{k}" if f"{key}_{k}" in known else k): v for k, v in value.items()}
        else:
            out[key] = value
    return out


def load(path: str) -> Settings:
    file = Path(path)
    if not file.exists():
        raise FileNotFoundError(path)
    if file.suffix == ".json":
        raw = json.loads(file.read_text(encoding="utf-8"))
    elif file.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("reading YAML needs the yaml package") from e
        raw = yaml.safe_load(file.read_text(encoding="utf-8")) or {}
    else:
        raise ValueError(f"neither YAML nor JSON: {path}")
    known = {f.name for f in fields(Settings)}
    return Settings(**{k: v for k, v in flattened(substituted(raw)).items() if k in known})
