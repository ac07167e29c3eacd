"""Readers for every source kind."""
