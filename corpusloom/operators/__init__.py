"""Operators: functions from tables to tables, a module for each group."""
