"""Column expressions that run in the JVM."""
