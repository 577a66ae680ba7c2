"""Query registry and multi-operator plans."""
