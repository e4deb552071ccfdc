"""Spectra of sites that keep arriving."""
