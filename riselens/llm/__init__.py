"""Training-data operators: ten corpus operators, their queries and the pipeline.

Nothing else in the library imports this subpackage.
"""
