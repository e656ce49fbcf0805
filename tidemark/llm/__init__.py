"""Training-data operators: one module per operator, registered through queries.py."""
