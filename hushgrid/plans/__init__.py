"""Plans of the noise-map jobs."""
