"""Column functions: text, identifiers, metadata, geometry. All run in the JVM unless they say otherwise."""
