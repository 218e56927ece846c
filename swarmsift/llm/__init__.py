"""Training-data operators and the queries that apply them to the given tables.

Nothing else in the library imports this subpackage; it imports only the
general helpers of ``swarmsift.session``.
"""
