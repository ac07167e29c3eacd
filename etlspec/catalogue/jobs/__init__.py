"""Job files used by the catalogue."""
