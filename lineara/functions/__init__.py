"""Column functions of the library: payload labels, owners, exact arithmetic, scripts."""
