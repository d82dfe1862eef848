"""Operators for event streams. All but the stateful ones take a batch table just as well."""
