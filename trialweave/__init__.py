"""Evaluation runs of language models as Spark tables, and the operators on them."""
