"""plans of hayloft."""
