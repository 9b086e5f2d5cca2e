"""Operators for preparing training data at scale.  Nothing outside imports this package."""
