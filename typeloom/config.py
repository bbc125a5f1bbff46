"""Settings: defaults, merged with what a file or a caller gives."""

from __future__ import annotations

import importlib
import importlib.util

import yaml

DEFAULTS = {
    "llm": {"batch_size": 25, "concurrency": 4, "max_tokens": 8000, "retries": 5, "timeout": 90, "api_key": ""},
    "taxonomy": {"mode": "discover", "sample": 180},
    "features": {"part_card": ["desc", "hs6", "material_field", "bu"]},
}
NEEDED, OPTIONAL = ("pyspark", "pyarrow", "pandas", "numpy", "yaml"), ("tokenizers", "tiktoken", "sentencepiece", "onnxruntime")


def merged(old: dict, new: dict) -> dict:
    """old with new laid over it, section by section; an empty api_key keeps the old one."""
    out = dict(old)
    for k, v in new.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merged(out[k], v)
        elif not (k == "api_key" and not v):
            out[k] = v
    return out


def load(path: str | None = None) -> dict:
    if path is None:
        return DEFAULTS
    with open(path, encoding="utf-8") as f:
        return merged(DEFAULTS, yaml.safe_load(f) or {})


def shown(config: dict) -> dict:
    """Settings without secrets."""
    return {k: shown(v) if isinstance(v, dict) else ("***" if k == "api_key" and v else v) for k, v in config.items()}


def check_environment() -> tuple[list[tuple[str, str, bool]], bool]:
    """Packages, their versions and whether each is needed; and whether all needed ones are there."""
    rows = []
    for name in NEEDED + OPTIONAL:
        there = importlib.util.find_spec(name) is not None
        rows.append((name, getattr(importlib.import_module(name), "__version__", "?") if there else "", name in NEEDED))
    return rows, all(v for _, v, needed in rows if needed)
