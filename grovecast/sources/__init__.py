"""Readers, JSON payload parsers and the fixture views over the driver tables."""
