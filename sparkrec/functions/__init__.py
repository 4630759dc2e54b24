"""Column expressions: text, JSON, prompts and scores. All stay in the JVM."""
