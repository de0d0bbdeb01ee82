"""Callbacks instead of lists: what a streaming extractor has ready goes to a function, frame by frame."""

from __future__ import annotations

from collections.abc import Callable


class Callbacks:
    """For classes whose ``push`` and ``flush`` give lists of frames. Whole streams are delivered by ``foreachBatch``."""

    def push_with(self, samples, callback: Callable[[tuple], None]) -> int:
        """Push samples, call back with each frame that is ready; their number. If pushing fails, nothing is called."""
        return _each(self.push(samples), callback)

    def flush_with(self, callback: Callable[[tuple], None]) -> int:
        """End the stream, call back with each frame that is left; their number."""
        return _each(self.flush(), callback)


def _each(frames: list[tuple], callback: Callable[[tuple], None]) -> int:
    for frame in frames:
        callback(frame)
    return len(frames)
