"""Queries composed of the operators: dashboard tiles, map layers, entity questions, test-table bindings."""
