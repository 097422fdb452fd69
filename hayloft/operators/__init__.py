"""operators of hayloft."""
