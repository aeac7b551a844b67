"""Column functions shared by all reports; every one builds JVM-side expressions."""
