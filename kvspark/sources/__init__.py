"""Tables on disk."""
