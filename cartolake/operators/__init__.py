"""Relational operators over catalog tables and over the data tables themselves."""
