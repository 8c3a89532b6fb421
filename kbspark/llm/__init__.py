"""Operators for training-data pipelines. Nothing else in kbspark imports this subpackage."""
