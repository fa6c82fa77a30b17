"""Column builders: scalar functions expressed in Catalyst."""
