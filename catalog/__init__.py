"""Registered queries over the sample tables, each with the SQL that must give the same rows."""
