"""Composed plans: the query catalog and its SQL twins."""
