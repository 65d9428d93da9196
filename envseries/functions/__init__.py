"""Column-level expressions: every helper returns a ``Column``."""
