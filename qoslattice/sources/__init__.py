"""Inputs: star schema adapters, CSV ingest, workspaces."""
