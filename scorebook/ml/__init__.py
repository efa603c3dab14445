"""Spark ML jobs: training, calibration, scoring, attributions."""
