"""Scans, sinks and the fixture views over the driver's tables."""
