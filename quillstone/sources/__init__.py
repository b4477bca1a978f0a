"""Readers of conversation exports, and writers."""
