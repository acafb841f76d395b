"""Operators for preparing training text and vectors at scale."""
