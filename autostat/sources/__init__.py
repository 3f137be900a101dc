"""Readers and result sinks."""
