"""Composite plans: one function per query."""
