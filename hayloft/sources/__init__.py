"""sources of hayloft."""
