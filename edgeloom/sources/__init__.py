"""Readers that turn files into typed fact DataFrames."""
