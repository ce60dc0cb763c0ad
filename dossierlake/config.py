"""Where a deployment keeps its tables and what its defaults are; each from an environment variable or an argument."""
from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """Variables are DOSSIERLAKE_ and the name in upper case. Folders are on storage that all executors reach."""

    index: str = "index"
    vectors: str = "vectors"
    output: str = "output"
    top_k: int = 5
    max_retries: int = 2
    workers: int = 2
    job_limit: int = 64

    def __post_init__(self):
        for name in ("top_k", "workers", "job_limit"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} is at least 1")
        if not 0 <= self.max_retries <= 5:
            raise ValueError("max_retries is from 0 to 5")

    @classmethod
    def from_env(cls, env=os.environ, **given) -> Config:
        found = {}
        for f in fields(cls):
            raw = given.get(f.name) if given.get(f.name) is not None else env.get(f"DOSSIERLAKE_{f.name.upper()}")
            if raw is not None:
                found[f.name] = type(f.default)(raw)
        return cls(**found)
