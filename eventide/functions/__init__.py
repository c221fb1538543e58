"""Functions for SQL text."""

from .sql import register, register_model

__all__ = ["register", "register_model"]
