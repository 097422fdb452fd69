"""streaming of hayloft."""
