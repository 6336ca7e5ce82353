"""Training-data operators: the ten dealt components and their thin queries."""
