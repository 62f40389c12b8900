"""Training-data operators: one module each, no module outside this folder imports them."""
