"""Readers, and the shared folder for materialised intermediate tables."""
