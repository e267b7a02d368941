"""State over time."""

from .state import *  # noqa: F403
