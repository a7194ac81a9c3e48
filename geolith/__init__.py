"""Geolith: a Spark engine for versioned geospatial feature data."""
