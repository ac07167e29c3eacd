"""Specs: reading, checking, and planning them."""
