"""functions of hayloft."""
