"""Readers and writers of event tables, coordinates, peaks, motifs, genomes and workbooks."""
