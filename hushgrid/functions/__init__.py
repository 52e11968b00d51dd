"""Functions of the noise-map jobs."""
