"""Training-data operators (ten of them), their queries and their SQL.

Nothing else in the library imports this subpackage.
"""
