"""Readers: raw trip files, zone tables, stored trip partitions, and the adapter from order tables to trips."""
