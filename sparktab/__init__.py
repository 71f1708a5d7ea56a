"""Spark-native operators for tabular machine-learning experiments."""

from sparktab.session import materialize, tune

__all__ = ["materialize", "tune"]
