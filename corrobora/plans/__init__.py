"""Named queries over the standard tables."""

from . import arrivals, files, inference, learning, modelling, quality, relational, series  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
