"""Spark-native site-audit analytics: crawls are tables, audits are queries."""

__version__ = "0.1.0"
