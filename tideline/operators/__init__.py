"""Operators: functions from DataFrame to DataFrame, lazy, with optional series keys."""
