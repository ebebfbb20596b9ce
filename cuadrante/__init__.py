"""Timetable and document analytics on Spark DataFrames."""
