"""Column expressions of the comparison engine; all run inside the JVM."""
