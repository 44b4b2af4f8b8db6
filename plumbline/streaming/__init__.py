"""Profiles of streams."""
