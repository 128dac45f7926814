"""Listings derived from the driver tables, queries over them, and their SQL twins."""
