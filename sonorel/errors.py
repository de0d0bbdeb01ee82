"""Errors: configuration errors raise on the driver; data errors are a column of the result."""

from __future__ import annotations


class ConfigError(ValueError):
    """An option that can't work, found before any job starts."""


#: Codes of the ``error`` column's struct (code, detail).
TOO_SHORT = "AudioTooShort"
BAD_RATE = "UnsupportedSampleRate"
BAD_CHANNELS = "UnsupportedChannels"
TOO_LARGE = "InputTooLarge"
NON_FINITE = "NonFiniteSample"
BAD_BLOB = "Deserialize"
TIMEOUT = "Timeout"
BAD_FRAME = "Config"
BAD_IO = "Io"
BAD_MODEL = "ModelLoad"
BAD_INFERENCE = "Inference"
