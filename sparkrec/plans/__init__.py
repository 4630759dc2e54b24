"""User-level pipelines composed of the operators."""
