"""Distributed operators over text, graphs, rules and labels."""
