"""Timed-text, text-quality and telemetry analytics as plain DataFrame functions."""
