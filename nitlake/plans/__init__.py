"""Whole jobs: curate, evaluate, describe, draw an epoch, stabilise, report."""
