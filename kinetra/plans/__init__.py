"""Registered queries over the given tables: adapters into the data model, the queries, and their SQL."""
