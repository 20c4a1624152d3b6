"""Training-data operators: ten corpus jobs written as Spark work.

Nothing else in the library imports this subpackage.
"""
