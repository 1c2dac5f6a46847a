"""Column -> Column builders (all JVM-side built-ins, inside whole-stage codegen)."""
