"""Column functions and text formats."""
