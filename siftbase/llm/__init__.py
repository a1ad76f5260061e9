"""Operators for preparing training text, one module each, and their registered queries."""
