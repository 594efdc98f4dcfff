"""Settings from the environment: blank values count as absent, booleans are strict."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any

#: Accepted spellings of booleans.
BOOLEANS = dict.fromkeys(("1", "true", "yes", "on"), True) | dict.fromkeys(("0", "false", "no", "off"), False)


def read(env: Mapping[str, str], name: str, default: Any) -> Any:
    """The variable's value as the type that its default has."""
    value = env.get(name, "").strip()
    if not value:
        return default
    if not isinstance(default, bool):
        return type(default)(value)
    if value.lower() not in BOOLEANS:
        raise ValueError(f"{name}: {value!r} is no boolean")
    return BOOLEANS[value.lower()]


@dataclass(frozen=True)
class Settings:
    """What a run of the engine can be told from outside."""

    master: str = "local[*]"
    shuffle_partitions: int = 8
    min_words: int = 15
    idle_seconds: float = 10.0
    max_pending: int = 20
    top_k: int = 10
    rerank: bool = True

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, prefix: str = "CAUSEGRAPH_") -> "Settings":
        given = os.environ if env is None else env
        return cls(**{f.name: read(given, prefix + f.name.upper(), f.default) for f in fields(cls)})


def session(settings: Settings | None = None, name: str = "causegraph"):
    """A Spark session with the engine's settings."""
    from pyspark.sql import SparkSession

    s = settings or Settings.load()
    return (
        SparkSession.builder.master(s.master).appName(name)
        .config("spark.sql.shuffle.partitions", s.shuffle_partitions).config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false").getOrCreate()
    )
