"""Syntax tree to checked plan (binder) to DataFrame (planner)."""
