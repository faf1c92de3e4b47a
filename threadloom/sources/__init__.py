"""Readers and writers: chat exports, media trees, workspaces."""
