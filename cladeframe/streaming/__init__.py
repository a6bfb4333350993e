"""Monitors of growing chain output."""
