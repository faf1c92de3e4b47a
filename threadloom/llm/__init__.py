"""Operators for preparing training data; nothing else in threadloom imports this package."""
