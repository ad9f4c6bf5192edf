"""Operators for preparing training text at scale; nothing else in wicker imports this package."""
