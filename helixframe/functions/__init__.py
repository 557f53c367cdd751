"""Column functions: alphabets and per-sequence scalars."""
