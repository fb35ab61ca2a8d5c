"""Measurements over fleets of 3D room scans, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
