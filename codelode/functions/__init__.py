"""Column functions: each takes and gives ``Column`` objects and runs inside the JVM."""
