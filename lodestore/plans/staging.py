"""Intermediate tables; see lodestore.staging."""

from lodestore.staging import shared_dir, stage, unstage

__all__ = ["shared_dir", "stage", "unstage"]
