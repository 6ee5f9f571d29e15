"""Parsing of the engine."""
