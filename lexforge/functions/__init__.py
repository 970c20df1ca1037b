"""Part of lexforge."""
