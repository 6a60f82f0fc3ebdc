"""Operators of the estimation, allocation and simulation chain."""
