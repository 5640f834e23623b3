"""Tidemill: stream and table analytics as plain DataFrame functions."""
