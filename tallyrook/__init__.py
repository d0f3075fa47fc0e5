"""Tallyrook: a PySpark-native engine for mining agent-session transcripts."""

__version__ = "0.1.0"
