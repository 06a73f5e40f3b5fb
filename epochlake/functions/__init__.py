"""functions of the event-related analytics engine."""
