"""Operators over spectra, predictions and series."""
