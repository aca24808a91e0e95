"""DataFrame -> DataFrame operators, by area."""
