"""Scalar functions over columns; all of them built from Spark's own expressions."""

from .scalar import *  # noqa: F403
