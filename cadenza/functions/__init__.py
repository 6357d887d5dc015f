"""Column functions: sample, window, transform, hearing and code-length expressions."""
