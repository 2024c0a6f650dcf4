"""First matches of known patterns: links and personal data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: name: (pattern, group)
LINKS = {
    "url": ("(https?://[^\\s]+)", 1),
    "domain": ("https?://([^/]+)", 1),
    "file_type": ("\\.([a-zA-Z0-9]+)$", 1),
    "anchor": (">(.*?)<", 1),
}
PERSONAL = {
    "tin": ("\\bTIN[:\\s]*(\\d+)", 1),
    "ssn": ("\\bSSN[:\\s]*(\\d{3}-\\d{2}-\\d{4})", 1),
    "dob": ("Date of Birth[:\\s]*([A-Za-z]+\\s\\d{1,2},\\s\\d{4})", 1),
    "expiry": ("Expiry[:\\s]*([A-Za-z]+\\s\\d{1,2},\\s\\d{4})", 1),
    "card": ("Card Number[:\\s]*(\\d{4}-\\d{4}-\\d{4}-\\d{4})", 1),
    "marks": ("Marks[:\\s]*(\\d+)", 1),
    "email": ("[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}", 0),
    "phone": ("\\b\\d{10}\\b|\\b\\(\\d{3}\\)\\s*\\d{3}-\\d{4}\\b", 0),
    "currency": ("\\$\\d+(,\\d{3})*(\\.\\d{2})?", 0),
    "dates": ("\\b\\d{1,2}/\\d{1,2}/\\d{2,4}\\b", 0),
    "alphabets": ("[A-Za-z]+", 0),
    "numerics": ("\\b\\d+\\b", 0),
    "special_characters": ("[^\\w\\s]", 0),
    "python_dictionary": ("\\{\\s*\"\\w+\":\\s*\\d+(?:\\s*,\\s*\"\\w+\":\\s*\\d+)*\\s*\\}", 0),
    "alphanumeric": ("[A-Za-z0-9]+", 0),
    "web": ("(https?://[^\\s]+)", 1),
}
#: Of a video's description.
VIDEO = {
    "duration": ("Duration[:\\s]*(\\d{1,2}:\\d{2}:\\d{2})", 1),
    "resolution": ("Resolution[:\\s]*(\\d{3,4}x\\d{3,4})", 1),
    "frame_rate": ("Frame Rate[:\\s]*(\\d+\\.?\\d*)fps", 1),
    "format": ("Format[:\\s]*(\\w+)", 1),
    "bitrate": ("Bitrate[:\\s]*(\\d+kbps)", 1),
    "codec": ("Codec[:\\s]*(\\w+)", 1),
    "audio_channels": ("Audio Channels[:\\s]*(\\d+)", 1),
    "audio_sample_rate": ("Audio Sample Rate[:\\s]*(\\d+Hz)", 1),
}


def extract(x: Column, table: dict[str, tuple[str, int]]) -> list[Column]:
    """One column a pattern with its first match; empty if there is none."""
    return [F.regexp_extract(x, p, g).alias(name) for name, (p, g) in table.items()]
