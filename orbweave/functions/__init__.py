"""Scalar helpers that Spark and a plain SQL engine spell differently."""
