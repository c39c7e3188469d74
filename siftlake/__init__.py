"""Security-telemetry analytics on Spark: normalise, land, detect, profile and certify OCSF tables."""

__version__ = "0.1.0"
