"""What to compute, as data: rule packs."""
