"""Column-to-column functions and the fixed values they rely on."""
