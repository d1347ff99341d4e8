"""Curves, cashflows, prices of instruments, and positions of them."""
