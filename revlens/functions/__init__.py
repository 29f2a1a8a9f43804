"""Column-expression builders (JVM-side, codegen-friendly)."""
