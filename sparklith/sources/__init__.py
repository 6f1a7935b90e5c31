"""Where tables come from and where they go."""

from .columns import attach_validity, column, described, named, slice_rows, strings, table, take, view, write_table  # noqa: F401
