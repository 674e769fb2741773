"""Attendance analytics on Spark."""
