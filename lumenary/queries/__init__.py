"""Registered queries, by theme."""
