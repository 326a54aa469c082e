"""Composed plans: retrieval, answering, evaluation reports and the command line."""
