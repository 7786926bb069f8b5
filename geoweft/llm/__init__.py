"""Operators for large training-data pipelines. Nothing else in geoweft imports this subpackage."""
