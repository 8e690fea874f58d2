"""Spark DataFrame analytics for multi-station soil and weather telemetry."""
