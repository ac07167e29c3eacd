"""Writers for every sink kind."""
