"""Helpers that several test modules import; conftest modules are never imported by name."""

from __future__ import annotations


def rows(frame, *columns):
    """Sorted tuples of the named columns."""
    picked = frame.select(*columns) if columns else frame
    return sorted((tuple(r) for r in picked.collect()), key=repr)
