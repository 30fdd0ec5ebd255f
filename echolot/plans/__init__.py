"""What plans need besides operators."""
