"""Airline timetable, fare, itinerary and booking jobs on Spark DataFrames."""
