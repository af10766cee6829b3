"""Operators for training-data pipelines. Nothing else in docloom imports this subpackage."""
