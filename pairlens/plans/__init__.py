"""Multi-step analyses composed from the operators."""
