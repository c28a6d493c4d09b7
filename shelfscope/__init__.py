"""Spark jobs over product-comparison catalogues."""
