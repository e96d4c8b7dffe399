"""Pixel and table operators."""
