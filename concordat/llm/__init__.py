"""Training-data operators: one module per operator, shared helpers in ``common``, ``links``, ``ranks`` and ``grams``."""
