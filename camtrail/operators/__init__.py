"""DataFrame -> DataFrame operators over detections, tracks, frames, rules and evaluation tables."""
