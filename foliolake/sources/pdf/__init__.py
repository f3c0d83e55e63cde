"""A PDF reader and writer for Spark's Python workers: no Spark in here but in ``scan``."""
