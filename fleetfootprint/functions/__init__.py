"""Column functions: each takes and returns ``Column`` and stays in generated JVM code."""
