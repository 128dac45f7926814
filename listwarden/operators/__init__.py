"""Relational building blocks: domains, reference lookups, frequencies, rules."""
