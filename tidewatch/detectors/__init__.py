"""Anomaly detectors and the classifier."""
