"""Captured tables and text lists."""
