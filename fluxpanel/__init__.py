"""Event detection and event-aligned analytics over (location x day) panels, as Spark plans."""
