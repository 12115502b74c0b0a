"""Verification engine: functions."""
