"""Spark-native operators for simulated-galaxy catalogues, particles, grids and spectra."""
