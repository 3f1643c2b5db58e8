"""Incremental variants of the additive aggregates."""
