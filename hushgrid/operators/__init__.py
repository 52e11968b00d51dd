"""Operators of the noise-map jobs."""
