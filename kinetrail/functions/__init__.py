"""Column functions: vectors, quaternions, scalar rules, labels, dimensions."""
