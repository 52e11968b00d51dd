"""Sources of the noise-map jobs."""
