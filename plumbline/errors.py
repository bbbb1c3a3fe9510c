"""Errors that the library raises."""

from __future__ import annotations


class PlumblineError(Exception):
    """Any error of the library's own."""


class ScanError(PlumblineError):
    """A scan cannot start: its path does not exist or cannot be listed."""


class ModeError(PlumblineError, ValueError):
    """A scan mode that there is none of."""


class RuleError(PlumblineError, ValueError):
    """A rule that cannot be registered."""


class LimitError(PlumblineError, ValueError):
    """A limit out of its range."""
