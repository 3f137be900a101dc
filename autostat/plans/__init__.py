"""Routing rules and the whole analysis as one call."""
