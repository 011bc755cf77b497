"""Readers and deterministic fixtures."""
