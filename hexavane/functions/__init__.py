"""Scalar functions over vectors."""

from .scoring import dot_f32_lanes, dot_f64

__all__ = ["dot_f32_lanes", "dot_f64"]
