"""Sources of webextract."""
