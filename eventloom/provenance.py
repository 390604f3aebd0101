"""What made a result: source, digest, configuration and its short identifier."""

from __future__ import annotations

import hashlib
import json
import platform
from dataclasses import dataclass, field, replace

VERSION = "0.1.0"


def sha256_file(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def plain(value):
    """JSON-ready form: tuples as lists, unknown types as text."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def config_hash(config: dict) -> str:
    text = json.dumps(plain(config), sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Provenance:
    source: str
    source_sha256: str | None = None
    config: dict = field(default_factory=dict)
    package_version: str = VERSION
    environment: dict = field(default_factory=lambda: {"python": platform.python_version(), "platform": platform.platform(terse=True)})

    @property
    def config_id(self) -> str:
        return config_hash(self.config)

    def derive(self, **more) -> Provenance:
        return replace(self, config={**self.config, **more})

    def to_dict(self) -> dict:
        return {"source": self.source, "source_sha256": self.source_sha256, "package_version": self.package_version, "config": plain(self.config), "environment": self.environment, "config_id": self.config_id}
