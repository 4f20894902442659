"""Operators for large text and log corpora; nothing outside this package imports it."""
