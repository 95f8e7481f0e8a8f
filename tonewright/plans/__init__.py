"""Registered queries and their SQL."""

from tonewright.plans import containers, flac, headers, pcm, spectral  # noqa: F401  each adds its own
from tonewright.plans.catalog import QUERIES, SQL  # noqa: F401
