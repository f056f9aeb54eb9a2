"""Binds the operators to the driver's tables: queries and their SQL."""
