"""Column functions: everything here is a JVM-side Spark expression."""
