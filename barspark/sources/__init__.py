"""Readers and writers of bars, labels and detections."""
