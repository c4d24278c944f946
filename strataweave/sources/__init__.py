"""Readers for component inventories and writers for results."""
