"""Readers, writers and generators."""

from .synthetic import synthetic_labels, synthetic_points, synthetic_posts, synthetic_times
from .tables import jdbc, lines, load, save_files, save_jdbc, save_table, table_exists

__all__ = ["jdbc", "lines", "load", "save_files", "save_jdbc", "save_table", "synthetic_labels", "synthetic_points", "synthetic_posts", "synthetic_times", "table_exists"]
