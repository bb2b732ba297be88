"""Operators for preparing training data: counting, cleaning, deduplicating, archiving."""
