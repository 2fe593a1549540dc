"""Column functions: JVM-side expressions over text, keys and vectors."""
