"""Readers and writers: POS CSV exports, normalized demand CSV, weather JSON,
region GeoJSON, candidate-file selection and result sinks."""
