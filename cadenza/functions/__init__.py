"""Column expressions for size, quality, colour, crop and range rules."""
