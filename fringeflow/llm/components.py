"""Kept for its importers: see fringeflow.components."""

from fringeflow.components import MAX_ROUNDS, connected_components

__all__ = ["MAX_ROUNDS", "connected_components"]
