"""The operators' settings as one value that is written to JSON and read back."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass(frozen=True)
class Search:
    top_k: int = 10
    min_score: float | None = None
    metric: str = "cosine"


@dataclass(frozen=True)
class Speculation:
    accept: float = 0.9
    reject: float = 0.3


@dataclass(frozen=True)
class Judge:
    most_claims: int = 10
    least_confidence: float = 0.5


@dataclass(frozen=True)
class Pipeline:
    fast: float = 0.95
    skip: float = 0.9


@dataclass(frozen=True)
class Settings:
    search: Search = field(default_factory=Search)
    speculation: Speculation = field(default_factory=Speculation)
    judge: Judge = field(default_factory=Judge)
    pipeline: Pipeline = field(default_factory=Pipeline)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> Settings:
        """Sections and values that are left out have their defaults; unknown ones are an error."""
        return _made(cls, json.loads(text))

    def to_file(self, path: str) -> None:
        Path(path).write_text(self.to_json(), encoding="utf-8")

    @classmethod
    def from_file(cls, path: str) -> Settings:
        return cls.from_json(Path(path).read_text(encoding="utf-8"))


def _made(kind: type, values: dict):
    known = {f.name: f for f in fields(kind)}
    if unknown := set(values) - set(known):
        raise ValueError(f"unknown settings {sorted(unknown)}")
    return kind(**{name: _made(known[name].default_factory, v) if isinstance(known[name].default_factory, type) and is_dataclass(known[name].default_factory) else v for name, v in values.items()})
