"""Scalar Column expressions (coercions and display rules)."""

from workboard.functions import coerce, display  # noqa: F401
