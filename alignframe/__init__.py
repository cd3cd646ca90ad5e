"""Spark jobs for preference data, reward scoring and pairwise judging."""

__version__ = "0.1.0"
