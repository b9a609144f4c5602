"""Training-data operators: extraction, de-duplication, filtering, language ID, mixing and output.

Nothing else in the library imports this subpackage; `queries.py` registers its queries.
"""
