"""Column -> Column functions (all JVM-side unless noted)."""
