"""Watching a repository."""
