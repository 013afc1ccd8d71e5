"""Tumour clonal reconstruction at cohort scale, as PySpark DataFrame plans."""
