"""Whole queries: the registry that the driver runs and the engine's API."""
