"""Marlstone: text-extraction evaluation, text similarity and table building on Spark."""
