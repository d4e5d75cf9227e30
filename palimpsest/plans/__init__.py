"""Stages put together."""
