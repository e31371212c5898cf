"""Scratch tables and checkpoints in the shared folder, as the rest of the library has them."""

from __future__ import annotations

from millrace.storage import cut, discard, release, scratch_dir, through_table

__all__ = ["cut", "discard", "release", "scratch_dir", "through_table"]
