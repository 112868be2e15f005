"""Event-time operators on Structured Streaming and their batch twins."""
