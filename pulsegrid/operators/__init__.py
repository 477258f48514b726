"""Relational building blocks shared by the indicators."""
