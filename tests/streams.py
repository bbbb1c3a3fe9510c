"""Waiting for streams whose timers keep them running after their last row."""

import time


def drained(query, rows: int, seconds: float = 60) -> None:
    """Stop the query once it has read ``rows`` rows."""
    end = time.monotonic() + seconds
    while query.isActive and sum(p["numInputRows"] for p in query.recentProgress) < rows and time.monotonic() < end:
        time.sleep(0.2)
    query.stop()
