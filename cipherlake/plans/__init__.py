"""The query catalogue by family, with SQL oracles."""
