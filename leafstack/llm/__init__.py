"""Operators for preparing training text: one module per problem, queries in ``queries``."""
