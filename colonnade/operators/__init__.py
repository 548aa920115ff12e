"""Kernel families; every function maps Columns to a Column."""
