"""Operators of a large-scale training-data pipeline; nothing else in quarry imports this subpackage."""
