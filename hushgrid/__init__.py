"""hushgrid: Spark jobs for noise-map data (readings, street noise, walking graph)."""
