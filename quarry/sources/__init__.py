"""sources of quarry."""
