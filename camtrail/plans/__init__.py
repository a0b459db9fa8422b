"""End-to-end compositions: asking a question log, building tracks from detections."""
