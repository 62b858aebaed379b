"""Training-data operators: language ID, dedup, quality, toxicity, tokenizing, mixing and LM scoring.

Nothing else in the library imports this subpackage; ``__spark_entry__.py``
adds its queries only when it is present.
"""
