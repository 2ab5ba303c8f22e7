"""Operators for training-data pipelines: one module per operator, `queries` has their registered queries."""
