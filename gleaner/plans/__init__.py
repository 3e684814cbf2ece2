"""Composite queries and the catalogue of registered ones."""
