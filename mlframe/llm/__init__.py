"""Operators for preparing training text at scale, each built by the method its module names."""
