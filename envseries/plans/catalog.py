"""The registered query catalogue: importing the query groups registers them."""

from __future__ import annotations

from . import q_analyse, q_clean, q_models, q_prepare  # noqa: F401  (register on import)
from .registry import REGISTRY, Entry

__all__ = ["REGISTRY", "Entry"]
