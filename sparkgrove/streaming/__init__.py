"""Streams of catalog entries and chats."""
