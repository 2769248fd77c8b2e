"""Kilnworks: an incremental, content-addressed materialization engine for Spark queries."""

__version__ = "0.1.0"
