"""Verification engine: operators."""
