"""Streaming of webextract."""
