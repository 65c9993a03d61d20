"""Windrow."""
