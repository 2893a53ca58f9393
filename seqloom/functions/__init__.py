"""Column functions over item arrays."""
