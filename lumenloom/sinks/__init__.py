"""Typed outputs."""
