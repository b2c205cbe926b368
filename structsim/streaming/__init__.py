"""Streams of changed files."""
