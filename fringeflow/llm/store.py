"""Kept for its importers: see fringeflow.store."""

from fringeflow.store import discard, drop_path, materialize, new_path, shared_dir

__all__ = ["discard", "drop_path", "materialize", "new_path", "shared_dir"]
