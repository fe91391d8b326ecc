"""Operators on texts sized in tokens. Nothing outside this folder imports it."""
