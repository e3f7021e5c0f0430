"""plans of quarry."""
