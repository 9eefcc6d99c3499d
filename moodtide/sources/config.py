"""Settings of a file, the environment or a parameter store, with defaults for what can't be parsed."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields


def parse_int(value: str | None, default: int) -> int:
    try:
        return int(value) if value is not None else default
    except ValueError:
        return default


def parse_bool(value: str | None, default: bool) -> bool:
    v = value.strip() if value is not None else ""
    return True if v in ("1", "t", "T", "true", "TRUE", "True") else False if v in ("0", "f", "F", "false", "FALSE", "False") else default


@dataclass(frozen=True)
class Settings:
    analysis_interval_minutes: int = 60
    top_posts_count: int = 5
    min_engagement_score: int = 10
    dry_run: bool = False
    language: str = "en"

    @classmethod
    def of(cls, values: Mapping[str, str | None]) -> Settings:
        got = {}
        for f in fields(cls):
            raw = values.get(f.name, values.get(f.name.upper()))
            kind = type(f.default)
            got[f.name] = parse_bool(raw, f.default) if kind is bool else parse_int(raw, f.default) if kind is int else raw or f.default
        return cls(**got)

    @classmethod
    def of_file(cls, path: str) -> Settings:
        """Settings of a YAML file's mapping ``settings`` (two levels of ``name: value`` lines)."""
        values: dict[str, str] = {}
        section = ""
        with open(path) as f:
            for line in f:
                name, colon, value = line.split(" #")[0].partition(":")
                if not colon or name.lstrip().startswith("#"):
                    continue
                if not name[0].isspace():
                    section = name.strip() if not value.strip() else ""
                if value.strip() and section in ("", "settings"):
                    values[name.strip()] = value.strip().strip("'\"")
        return cls.of(values)

    @classmethod
    def of_environment(cls, environ: Mapping[str, str] = os.environ, prefix: str = "") -> Settings:
        return cls.of({f.name: environ.get((prefix + f.name).upper()) for f in fields(cls)})

    @classmethod
    def of_store(cls, get: Callable[[list[str]], Mapping[str, str]], prefix: str) -> Settings:
        """Settings of a parameter store: get takes full names and returns the values of those that there are."""
        found = get([f"{prefix}/{f.name}" for f in fields(cls)])
        return cls.of({f.name: found.get(f"{prefix}/{f.name}") for f in fields(cls)})
