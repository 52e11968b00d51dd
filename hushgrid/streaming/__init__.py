"""Streaming of the noise-map jobs."""
