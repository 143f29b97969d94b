"""Bindings to the driver tables, registered queries and end-to-end pipelines."""
