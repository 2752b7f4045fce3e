"""Part of the review anomaly engine."""
