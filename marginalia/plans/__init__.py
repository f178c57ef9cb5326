"""Composite jobs and the registry that binds every operator to the driver tables."""
