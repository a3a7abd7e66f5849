"""Training-data operators: one module an operator, queries in :mod:`graphloom.llm.queries`."""
