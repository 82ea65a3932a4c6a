"""Column functions and Arrow-batched scalar functions."""
