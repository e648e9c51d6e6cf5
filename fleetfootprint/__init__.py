"""Energy use and carbon impact of computer fleets, as PySpark jobs."""
