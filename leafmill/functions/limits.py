"""Resource limits.  Each is a refusal of one document, never a truncation and never a failed task."""

from __future__ import annotations

from dataclasses import dataclass, fields

KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30


class LimitExceeded(Exception):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


@dataclass(frozen=True)
class Limits:
    #: A document is one row of a Spark table, so the default is lower than a stand-alone tool could afford.
    max_input_bytes: int = 32 * MIB
    max_depth: int = 256
    max_archive_entries: int = 4096
    max_archive_entry_bytes: int = 256 * MIB
    max_archive_total_bytes: int = GIB
    max_archive_ratio: int = 200
    max_decoded_text_bytes: int = 256 * MIB
    max_nodes: int = 16 * MIB
    max_facet_rows: int = MIB
    max_resources: int = 256
    max_resource_bytes: int = 128 * MIB
    max_output_bytes: int = 512 * MIB
    max_report_groups: int = 16 * KIB
    max_report_samples: int = 4

    def __post_init__(self) -> None:
        for f in fields(self):
            if getattr(self, f.name) <= 0:
                raise ValueError(f"{f.name} must be positive")
        if self.max_depth > 900:
            raise ValueError("max_depth can be at most 900 here: trees are walked on Python's stack")


DEFAULT = Limits()
