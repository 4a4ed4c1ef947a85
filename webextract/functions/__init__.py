"""Functions of webextract."""
