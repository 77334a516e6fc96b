"""Repair and evaluation of noisy text as DataFrame transformations."""
