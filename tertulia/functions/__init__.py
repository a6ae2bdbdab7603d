"""Column expressions: text, scores and prompts. Everything here runs inside the JVM."""
