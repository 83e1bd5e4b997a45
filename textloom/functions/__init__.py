"""Column functions: pure expressions over built-ins, usable in any select, filter or lambda."""
