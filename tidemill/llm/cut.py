"""Cutting lineage: frames written once to the folder that driver and executors share."""

from __future__ import annotations

from tidemill.scratch import drop
from tidemill.scratch import kept as cut

__all__ = ["cut", "drop"]
