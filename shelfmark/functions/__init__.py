"""Column expressions; all stay on the JVM side."""
