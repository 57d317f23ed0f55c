"""gleaner: event-sourced triage analytics on Spark."""
