"""Column functions: text, network, masking, and the fixed tables they use."""
