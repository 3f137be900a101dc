"""Operators for preparing training text: filters, joins, deduplication, tokenizing, scoring, mixing, archives."""
