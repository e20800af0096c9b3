"""Operators for training-data pipelines: one module per operator, each with its own interface; ``queries`` registers them."""
