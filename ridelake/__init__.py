"""Ride-demand analytics expressed as lazy Spark DataFrame operators."""
