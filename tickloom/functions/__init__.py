"""Scalar Column builders."""
