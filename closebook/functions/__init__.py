"""Column expressions; nothing here reads data or leaves the JVM."""
