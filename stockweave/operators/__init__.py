"""DataFrame(s) -> DataFrame operators."""
