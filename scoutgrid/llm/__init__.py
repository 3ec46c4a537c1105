"""Training-data operators: each module is one operator with its own interface; ``queries`` applies them to whole tables."""
