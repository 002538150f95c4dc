"""The small SQL dialect: text to syntax tree, without Spark."""

from .parser import parse

__all__ = ["parse"]
