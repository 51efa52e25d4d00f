"""Training-data pipeline operators.

Nothing else in the library imports this subpackage.
"""
