"""Readers, and adapters that give benchmark tables the shapes of slides and detections."""
