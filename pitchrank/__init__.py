"""Spark operators and jobs that score pitches from pitch-tracking tables."""

from pitchrank.params import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings"]
