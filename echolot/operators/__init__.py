"""Operators over frames of units and pairs."""
