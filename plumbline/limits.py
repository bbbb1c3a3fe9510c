"""Limits of a scan, handed to the parsers with their task: nothing global, so scans in one session don't meet."""

from __future__ import annotations

from dataclasses import dataclass, fields

from .errors import LimitError


@dataclass(frozen=True)
class Limits:
    """What a parser reads of a file before it reports the rest as limited.

    ``file_bytes`` must be positive; 0 lifts any of the others."""

    file_bytes: int = 256 << 20
    #: Mails within mails.
    depth: int = 5
    csv_rows: int = 200_000
    field_chars: int = 4 << 20
    attachments: int = 64
    #: Other attachments within attachments.
    nested: int = 2

    def __post_init__(self) -> None:
        for f in fields(self):
            if getattr(self, f.name) < (f.name == "file_bytes"):
                raise LimitError(f"{f.name}: {getattr(self, f.name)} is too small")

    def over(self, name: str, n: int) -> bool:
        """Whether ``n`` is more than the limit ``name`` allows."""
        most = getattr(self, name)
        return bool(most) and n > most


DEFAULT = Limits()
