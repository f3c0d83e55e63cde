"""foliolake: document analytics on Spark.

Layer T (``functions``, ``operators``, ``plans``) works on any text or geometry
column with built-in expressions; layer D (``sources``) turns PDF bytes into the
typed tables layer T reads.
"""
