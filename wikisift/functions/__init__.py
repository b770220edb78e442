"""Column expressions; everything here runs JVM-side, no Python UDFs."""
