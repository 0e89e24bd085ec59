"""Column builders: values, colours, names. All are native expressions."""
