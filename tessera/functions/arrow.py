"""Arrow batches in pieces: a batch has up to 10,000 rows by Spark's default, whose Python objects take many times its own memory."""

from __future__ import annotations

from collections.abc import Iterator

#: Rows whose Python objects a task holds at a time.
SLICE = 128


def slices(batches: Iterator, rows: int = SLICE) -> Iterator:
    """The batches, or arrays, cut into pieces of at most so many rows, in order; nothing is copied."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.slice(i, rows)
