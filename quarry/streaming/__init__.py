"""streaming of quarry."""
