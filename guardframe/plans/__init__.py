"""Configuration, registered queries and their SQL."""
