"""Column functions: token strings and arrays, rotations."""
