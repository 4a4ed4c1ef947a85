"""Plans of webextract."""
