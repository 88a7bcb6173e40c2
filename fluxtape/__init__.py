"""A Spark engine for fixed-width, 80-column evaluated-data libraries."""
