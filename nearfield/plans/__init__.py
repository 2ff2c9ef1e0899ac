"""Configuration and planning rules."""
