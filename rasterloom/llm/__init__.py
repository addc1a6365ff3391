"""Operators of a training-data pipeline, one module per operator; queries and their SQL are in ``queries``."""
