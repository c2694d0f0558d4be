"""Readers and writers: trees, alignments, calibrations, taxonomies, samples, program outputs."""
