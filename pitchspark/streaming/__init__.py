"""Operators over tracking that arrives while a match goes on."""
