"""Schemas, event parsing, reference tables, the event store, GeoJSON export."""
