"""Reading and writing the formats around the engine."""
