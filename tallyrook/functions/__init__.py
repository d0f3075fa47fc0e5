"""Column functions: all JVM-side expressions."""

from .text import *  # noqa: F403
