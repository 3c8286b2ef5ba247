"""Operators of a training-data pipeline; each module holds one operator, its query and its SQL."""
