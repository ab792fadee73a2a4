"""Readers of FASTA, haplotype, RepeatMasker and TRF text, and a simulator."""
