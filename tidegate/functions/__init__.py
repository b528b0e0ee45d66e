"""Column functions over packet fields; all stay inside the JVM."""
