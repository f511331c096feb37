"""Settings of retrieval and generation, with overrides from the environment (LODESTRATA_ and the field's name in capitals)."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

PREFIX = "LODESTRATA_"


@dataclass(frozen=True)
class Settings:
    """Counts must be positive, and candidates at least as many as results. Models are named by id and revision."""

    top_k: int = 5
    candidate_k: int = 20
    rrf_k: int = 60
    rows_per_parent: int = 2
    encoder_id: str = "hashed-words"
    encoder_revision: str | None = None
    encoder_batch: int = 32
    generator_id: str | None = None
    generator_revision: str | None = None
    adapter_id: str | None = None
    adapter_revision: str | None = None
    device: str = "auto"
    max_input_tokens: int = 4_096
    max_new_tokens: int = 128

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if f.type == "int" and (not isinstance(value, int) or isinstance(value, bool) or value < 1):
                raise ValueError(f"{f.name} must be a positive whole number, not {value!r}")
            if f.type != "int" and value is not None and not value.strip():
                raise ValueError(f"{f.name} is blank")
        if self.candidate_k < self.top_k:
            raise ValueError("candidate_k is below top_k")

    @classmethod
    def from_environment(cls, environment: Mapping[str, str] | None = None) -> Settings:
        """The defaults, but for what the environment sets; a value that doesn't fit raises and names its variable."""
        given = os.environ if environment is None else environment
        found: dict[str, object] = {}
        for f in fields(cls):
            name = PREFIX + f.name.upper()
            if name not in given:
                continue
            try:
                found[f.name] = int(given[name]) if f.type == "int" else (given[name].strip() or None if "None" in str(f.type) else given[name])
            except ValueError as error:
                raise ValueError(f"{name} must be a whole number, not {given[name]!r}") from error
        return cls(**found)
