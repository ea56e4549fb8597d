"""Operators for preparing training text and code; nothing else in the library imports this subpackage."""
