"""Scalar functions as Column expressions, and exact pandas versions where no built-in has the semantics."""
