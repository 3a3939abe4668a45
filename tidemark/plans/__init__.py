"""Queries composed from the operators, artifacts and checks."""
