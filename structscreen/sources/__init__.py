"""Readers and writers: structure, ligand, sequence, alignment and prediction files."""
