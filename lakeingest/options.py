"""Ingestion options and the rule by which a preset fixes some of them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

SUPPORTED_FORMATS = ("csv", "xlsx", "json", "ndjson", "jsonl")
PRESETS = ("default", "bi", "gis")


@dataclass(frozen=True)
class IngestOptions:
    """What an ingestion run does with its sources.

    ``continue_on_error`` is the batch fault policy and, for line-delimited JSON,
    also decides whether malformed lines are quarantined or fail the file.
    """

    normalize: bool = False
    flatten: bool = False
    all_sheets: bool = False
    preserve_sensitive: bool = True
    continue_on_error: bool = False
    compression: str = "snappy"
    preset: str = "default"
    extra_sensitive: tuple[str, ...] = field(default=())
    # "hash": same-named sources get a path hash; "overwrite": the last path wins.
    collision: str = "hash"
    # Types per file instead of per layout.
    per_file_schema: bool = False
    # Rows whose types bind the rest of the file: a later misfit fails it. 0 = widen instead.
    strict_sample: int = 0
    hash_sources: bool = True
    # Files of the first wave where an error stops the run (later waves grow): none begins behind a failing file.
    wave_files: int = 10_000
    # JSON documents of more bytes are cut into records by many tasks; results are the same. None: the engine's limit.
    document_bytes: int | None = None

    def resolve(self) -> "IngestOptions":
        """Apply the preset: ``bi`` and ``gis`` force the three cleaning switches on."""
        if self.preset not in PRESETS:
            raise ValueError(f"preset desconhecido: {self.preset}")
        if self.collision not in ("hash", "overwrite"):
            raise ValueError(f"regra de colisão desconhecida: {self.collision}")
        if self.wave_files < 1:
            raise ValueError(f"tamanho de onda inválido: {self.wave_files}")
        if self.preset == "default":
            return self
        return replace(self, normalize=True, flatten=True, preserve_sensitive=True)

    @property
    def casts_coordinates(self) -> bool:
        return self.preset in ("bi", "gis")
