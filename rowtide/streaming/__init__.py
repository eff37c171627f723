"""Live forms of batch operators."""
