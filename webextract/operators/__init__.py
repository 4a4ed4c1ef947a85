"""Operators of webextract."""
