"""Conversation and text-corpus analytics on Spark."""
