"""Column expressions: cell ids, map tiles, geometry. All JVM-side, no Python UDFs."""
