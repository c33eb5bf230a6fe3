"""DataFrame operators for market series."""
