"""functions of quarry."""
