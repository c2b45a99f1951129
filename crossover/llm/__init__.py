"""Operators for preparing training data, and their registered queries (``crossover.llm.queries``)."""
