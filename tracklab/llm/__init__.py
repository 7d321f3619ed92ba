"""Training-data operators: each module is one operator, ``queries`` registers the thin queries over them."""
