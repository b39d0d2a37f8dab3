"""From request parameters to plans."""
