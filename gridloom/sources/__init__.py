"""Readers and writers of grids, structures and stores."""
