"""Operators on signals: comparison, search, sections, budgets, spectra."""
