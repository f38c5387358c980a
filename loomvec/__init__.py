"""Paired, high-dimensional vector profiles (spectra) analysed with PySpark.

The relational and numeric work is declared with the DataFrame and SQL API so
that Catalyst plans it; Python runs only where no built-in operator exists
(audio decoding, Fourier transforms).
"""
