"""Whole plans: scoring, reports, and residential-indicator upkeep."""
