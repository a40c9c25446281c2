"""Whole endpoints and the registered queries."""
