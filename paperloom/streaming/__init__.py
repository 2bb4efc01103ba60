"""Structured streams over the event log, with batch counterparts that give the same rows."""
