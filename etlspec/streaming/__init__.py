"""Micro-batch runs."""
