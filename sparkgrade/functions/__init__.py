"""Part of the sparkgrade engine."""
