"""Operational limits, from the environment or their defaults."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass

PREFIX = "PAGEMILL_"
_TRUE = ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Settings:
    data_dir: str
    cache_dir: str
    max_workers: int = 2
    max_upload_bytes: int = 52_428_800
    max_pages: int = 200
    speech_rate_min: float = 0.5
    speech_rate_max: float = 2.0
    max_pending_jobs: int = 10
    job_retention_hours: int = 0
    review_url: str = ""
    review_model: str = ""
    review_enabled: bool = False


def _read(env: Mapping[str, str], name: str, kind: Callable, default):
    """A value that can't be read counts as absent."""
    raw = env.get(PREFIX + name, "").strip()
    if not raw:
        return default
    if kind is bool:
        return raw.lower() in _TRUE
    try:
        return kind(raw)
    except ValueError:
        return default


def load(env: Mapping[str, str] | None = None) -> Settings:
    """Counts below one become one, a negative retention none; limits that make no sense are errors."""
    env = os.environ if env is None else env
    home = os.path.expanduser("~")
    path = lambda name, last: os.path.abspath(os.path.expanduser(_read(env, name, str, os.path.join(home, last))))
    s = Settings(
        data_dir=path("DATA_DIR", ".pagemill"),
        cache_dir=path("CACHE_DIR", ".cache/pagemill"),
        max_workers=max(1, _read(env, "MAX_WORKERS", int, Settings.max_workers)),
        max_upload_bytes=_read(env, "MAX_UPLOAD_BYTES", int, Settings.max_upload_bytes),
        max_pages=_read(env, "MAX_PAGES", int, Settings.max_pages),
        speech_rate_min=_read(env, "SPEECH_RATE_MIN", float, Settings.speech_rate_min),
        speech_rate_max=_read(env, "SPEECH_RATE_MAX", float, Settings.speech_rate_max),
        max_pending_jobs=max(1, _read(env, "MAX_PENDING_JOBS", int, Settings.max_pending_jobs)),
        job_retention_hours=max(0, _read(env, "JOB_RETENTION_HOURS", int, 0)),
        review_url=_read(env, "REVIEW_URL", str, ""),
        review_model=_read(env, "REVIEW_MODEL", str, ""),
        review_enabled=_read(env, "REVIEW_ENABLED", bool, False),
    )
    if s.max_upload_bytes < 1 or s.max_pages < 1:
        raise ValueError("size and page limits must be positive")
    if s.speech_rate_min <= 0 or s.speech_rate_max < s.speech_rate_min:
        raise ValueError("invalid speech-rate limits")
    return s
