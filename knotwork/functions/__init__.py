"""Column expressions: text, names, identifiers, references. Built-in functions only."""
