"""Readers (S1-S10) and writers (S11-S14) for conversation corpora."""
