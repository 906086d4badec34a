"""Guarded SQL, questions, analysis plans and jobs."""
