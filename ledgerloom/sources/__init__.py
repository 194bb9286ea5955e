"""Trees of files, existing stores and ticket trackers as tables."""

from . import files, trackers

__all__ = ["files", "trackers"]
