"""Corpus operators for large-scale training-data pipelines.

One module per operator; ``queries`` registers them for the driver. Nothing else
in the library imports this subpackage.
"""
