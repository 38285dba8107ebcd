"""Engine settings: dataclass defaults, overridable from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from newsloom import constants as C


@dataclass(frozen=True)
class Settings:
    """Tunable values; every field can be set by ``NEWSLOOM_<FIELD>``."""

    site_domain: str = "example.com"
    default_source: str = "news"
    chunk_tokens: int = C.CHUNK_TOKENS
    overlap_tokens: int = C.OVERLAP_TOKENS
    vector_dim: int = 64
    table_buckets: int = 64

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> "Settings":
        env = os.environ if env is None else env
        chosen = {}
        for field in fields(cls):
            raw = env.get(f"NEWSLOOM_{field.name.upper()}")
            if raw is not None:
                chosen[field.name] = type(field.default)(raw)
        return cls(**chosen)
