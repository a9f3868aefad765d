"""Claims plans: the named queries and analyses composed from the generic operators."""
