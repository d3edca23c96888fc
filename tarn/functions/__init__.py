"""Values of loose types and the functions on them."""
