"""placespark: place descriptions to geometries, and their scores, as Spark jobs."""
