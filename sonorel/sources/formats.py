"""Sample formats of audio files, as arrays: PCM and floats of either byte order, mu-law, A-law, and IMA ADPCM by packets."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np

from sonorel import errors
from sonorel.configs import DecodeLimits

# Fixed values of IMA ADPCM: the quantiser's steps, and how a code moves the step's place.
IMA_STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
    876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
IMA_MOVES = (-1, -1, -1, -1, 2, 4, 6, 8)
#: Blocks that are decoded at once, between two looks at the clock.
PACKET_BLOCKS = 4096


class DecodeError(Exception):
    def __init__(self, code: str, detail: str):
        super().__init__(detail)
        self.code = code


class Clock:
    """Raises once decoding has taken longer than the limit."""

    def __init__(self, limits: DecodeLimits, now: Callable[[], float] = time.monotonic):
        self.limit, self.now = limits.timeout, now
        self.began = now()

    def check(self) -> None:
        if self.limit is not None and self.now() - self.began > self.limit:
            raise DecodeError(errors.TIMEOUT, "decoding took too long")


def chunks(data: bytes, order: str, clock: Clock) -> Iterator[tuple[bytes, int, int]]:
    """(name, place of its content, size it states) of the chunks of a RIFF or IFF file; the content may be cut off."""
    at = 12
    while at + 8 <= len(data):
        clock.check()
        size = int.from_bytes(data[at + 4 : at + 8], order)
        yield data[at : at + 4], at + 8, size
        at += 8 + size + (size & 1)


def content(data: bytes, at: int, size: int, limits: DecodeLimits) -> bytes:
    """A chunk's content, or what there is of one that is cut off; in integrity mode that is an error."""
    raw = data[at : at + size]
    if len(raw) < size and limits.integrity_mode:
        raise DecodeError(errors.BAD_IO, f"data ends after {len(raw)} of {size} bytes")
    return raw


def within(frames: int, limits: DecodeLimits) -> int:
    """The number of frames, which is told from sizes before any sample is decoded."""
    if limits.max_samples is not None and frames > limits.max_samples:
        raise DecodeError(errors.TOO_LARGE, f"{frames} samples")
    return frames


def pcm(raw: bytes, bits: int, order: str, unsigned: bool = False) -> np.ndarray:
    """Whole numbers of 8 to 32 bits, scaled to +-1; samples of odd widths are in the upper bits of their bytes."""
    width = -(-bits // 8)
    if unsigned:
        return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3)[:, :: 1 if order == "little" else -1].astype(np.int32)
        return ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    return (np.frombuffer(raw, f"{'<' if order == 'little' else '>'}i{width}") / float(1 << (8 * width - 1))).astype(np.float32)


def floats(raw: bytes, bits: int, order: str) -> np.ndarray:
    return np.frombuffer(raw, f"{'<' if order == 'little' else '>'}f{bits // 8}").astype(np.float32)


def mu_law(raw: bytes) -> np.ndarray:
    u = ~np.frombuffer(raw, np.uint8)
    size = ((((u & 15).astype(np.int32) << 3) + 132) << (u >> 4 & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.float32) / 32768


def a_law(raw: bytes) -> np.ndarray:
    a = np.frombuffer(raw, np.uint8) ^ 0x55
    rise = (a >> 4 & 7).astype(np.int32)
    size = (((a & 15).astype(np.int32) << 4) + np.where(rise, 264, 8)) << np.maximum(rise - 1, 0)
    return np.where(a & 128, size, -size).astype(np.float32) / 32768


def ima_frames(n: int, align: int, channels: int) -> int:
    """Frames of ``n`` bytes of blocks, at most: a header gives one of each channel, every four bytes eight more."""

    def of(size: int) -> int:
        return 0 if size < 4 * channels else 1 + (size - 4 * channels) // (4 * channels) * 8

    return n // align * of(align) + of(n % align)


def _ima_blocks(blocks: np.ndarray, channels: int, limits: DecodeLimits) -> np.ndarray:
    """Samples [frames, channels] of blocks of one size, all at once, sample by sample; unsound blocks are left out."""
    head = np.ascontiguousarray(blocks[:, : 4 * channels]).reshape(len(blocks), channels, 4)
    sound = (head[:, :, 2] < len(IMA_STEPS)).all(axis=1)
    if limits.integrity_mode and not sound.all():
        raise DecodeError(errors.BAD_IO, "a block starts with no step")
    blocks, head = blocks[sound], head[sound]
    words = (blocks.shape[1] - 4 * channels) // (4 * channels)
    codes = blocks[:, 4 * channels : 4 * channels * (words + 1)].reshape(len(blocks), words, channels, 4).transpose(0, 2, 1, 3).reshape(len(blocks), channels, words * 4)
    codes = np.stack([codes & 15, codes >> 4], axis=-1).reshape(len(blocks), channels, words * 8)
    value = (head[:, :, 0].astype(np.int32) | head[:, :, 1].astype(np.int32) << 8).astype(np.uint16).view(np.int16).astype(np.int32)
    place, steps, moves = head[:, :, 2].astype(np.int32), np.array(IMA_STEPS, np.int32), np.array(IMA_MOVES, np.int32)
    out = np.empty((len(blocks), words * 8 + 1, channels), np.int16)
    out[:, 0] = value
    for k in range(words * 8):
        code = codes[:, :, k].astype(np.int32)
        step = steps[place]
        size = (step >> 3) + (code & 1) * (step >> 2) + (code >> 1 & 1) * (step >> 1) + (code >> 2 & 1) * step
        value = np.clip(np.where(code & 8, value - size, value + size), -32768, 32767)
        place = np.clip(place + moves[code & 7], 0, len(IMA_STEPS) - 1)
        out[:, k + 1] = value
    return out.reshape(-1, channels)


def ima_adpcm(raw: bytes, align: int, channels: int, limits: DecodeLimits, clock: Clock) -> np.ndarray:
    """Interleaved samples, packet by packet. A block whose header names no step is skipped, and so is what is left of a
    block that ends within a word; in integrity mode both are errors."""
    if align < 4 * channels:
        raise DecodeError(errors.BAD_IO, f"blocks of {align} bytes")
    within(ima_frames(len(raw), align, channels), limits)
    whole, out = len(raw) // align, []
    blocks = np.frombuffer(raw, np.uint8, whole * align).reshape(whole, align)
    for at in range(0, whole, PACKET_BLOCKS):
        clock.check()
        out.append(_ima_blocks(blocks[at : at + PACKET_BLOCKS], channels, limits))
    rest = raw[whole * align :]
    if limits.integrity_mode and len(rest) % (4 * channels):
        raise DecodeError(errors.BAD_IO, f"the last block ends after {len(rest)} bytes")
    if len(rest) >= 4 * channels:
        out.append(_ima_blocks(np.frombuffer(rest, np.uint8)[None], channels, limits))
    return (np.concatenate(out) if out else np.empty((0, channels), np.int16)).ravel().astype(np.float32) / 32768
