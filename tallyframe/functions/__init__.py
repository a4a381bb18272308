"""Column expressions: text, exact decimals and strict dates. All run in the JVM."""
