"""Composition analytics over binary and text blobs, declared as Spark plans."""
