"""operators of quarry."""
