"""Registered queries, one module for each part of the engine."""
