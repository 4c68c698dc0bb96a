"""Operators over tables of bytes, symbols, tokens, scanlines and pixels."""
