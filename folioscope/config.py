"""Settings from the environment: typed, with defaults, all errors reported at once."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


class ConfigError(ValueError):
    """One or more settings can't be used; the message has a line for each and holds no secret's value."""


@dataclass(frozen=True)
class Settings:
    """Each field is read from the variable of its upper-case name, after a prefix. No timeout (none) waits for ever."""

    route_limit: int = 50
    candidate_limit: int = 50
    rerank_limit: int = 12
    rerank_min_score: float = 0.1
    child_limit: int = 600
    parent_limit: int = 1800
    overlap_ratio: float = 0.1
    rerank_inputs: int = 24
    model_window: int = 16384
    evidence_ratio: float = 0.5
    most_file_bytes: int = 100 << 20
    most_pages: int = 1000
    most_uploads: int = 20
    most_question_chars: int = 8000
    most_output_tokens: int = 8192
    answer_timeout: float | None = None
    tables_path: str = "tables"
    index_path: str = "index"
    files_path: str = "files"
    api_key: str = ""

    def __repr__(self) -> str:
        shown = {f.name: getattr(self, f.name) for f in fields(self)} | {"api_key": "[REDACTED]" if self.api_key else ""}
        return f"Settings({', '.join(f'{k}={v!r}' for k, v in shown.items())})"


_BOUNDS = {"rerank_min_score": (0.0, 1.0), "overlap_ratio": (0.0, 0.5), "evidence_ratio": (0.4, 0.6), "answer_timeout": (0.001, float("inf"))}


def load(env: Mapping[str, str], prefix: str = "FOLIOSCOPE_") -> Settings:
    """Blank variables count as unset, and so does ``none`` where there is no default. Numbers must be positive, or lie within their bounds."""
    values, errors = {}, []
    for field in fields(Settings):
        name, kind = prefix + field.name.upper(), type(field.default) if field.default is not None else float
        raw = env.get(name, "").strip()
        if not raw or (field.default is None and raw.lower() == "none"):
            continue
        try:
            values[field.name] = kind(raw)
        except ValueError:
            errors.append(f"{name}: not of type {kind.__name__}")
            continue
        low, high = _BOUNDS.get(field.name, (1, float("inf")))
        if kind is not str and not low <= values[field.name] <= high:
            errors.append(f"{name}: not within {low} and {high}")
    held = Settings(**values) if not errors else None
    if held and held.parent_limit < held.child_limit:
        errors.append(f"{prefix}PARENT_LIMIT: below the limit of children")
    if errors or held is None:
        raise ConfigError("\n".join(errors))
    return held
