import io
import struct
import wave

import numpy as np
import pytest

from sonorel import errors
from sonorel.configs import DecodeLimits
from sonorel.operators.matching import dtw_cost
from sonorel.sources import audio, blobs, formats


def wav(x: np.ndarray, rate: int = 8000, width: int = 2) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1 if x.ndim == 1 else x.shape[1])
        w.setsampwidth(width)
        w.setframerate(rate)
        scaled = np.round(x * ((1 << (8 * width - 1)) - 1)).astype(np.int64)
        raw = scaled.ravel()
        w.writeframes((raw + 128).astype(np.uint8).tobytes() if width == 1 else b"".join(int(v).to_bytes(width, "little", signed=True) for v in raw))
    return out.getvalue()


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wav_widths(width):
    x = np.sin(np.arange(100) / 7) * 0.5
    y, rate = audio.decode_to_mono(wav(x, 8000, width))
    assert rate == 8000 and np.abs(y - x).max() < 2.0 ** (2 - 8 * width) + 1e-6


def test_downmix_resample_and_limits():
    x = np.stack([np.full(80, 0.5), np.full(80, -0.25)], axis=1)
    y, _ = audio.decode_to_mono(wav(x))
    assert np.allclose(y, 0.125, atol=1e-3)
    assert len(audio.decode_to_mono(wav(x), rate=4000)[0]) == 40
    for limits, rate in ((DecodeLimits(max_bytes=50), None), (DecodeLimits(max_samples=79), None), (DecodeLimits(max_samples=100), 16000)):
        with pytest.raises(audio.DecodeError) as e:
            audio.decode_to_mono(wav(x), limits, rate)
        assert e.value.code == errors.TOO_LARGE
    cut = wav(x)[:-10]
    assert len(audio.decode_to_mono(cut)[0]) == 77
    with pytest.raises(audio.DecodeError):
        audio.decode_to_mono(cut, DecodeLimits(integrity_mode=True))
    with pytest.raises(audio.DecodeError):
        audio.decode_to_mono(b"ID3 something else")


def aiff(raw: bytes, channels: int, bits: int, kind: bytes = b"", rate: int = 44100) -> bytes:
    common = struct.pack(">HIHHQ", channels, len(raw) // (channels * bits // 8), bits, 16383 + 15, rate << 48) + (kind + b"\0\0" if kind else b"")
    body = (b"AIFC" if kind else b"AIFF") + b"COMM" + struct.pack(">I", len(common)) + common + b"NAME\0\0\0\1n\0" + b"SSND" + struct.pack(">III", 8 + len(raw), 0, 0) + raw
    return b"FORM" + struct.pack(">I", len(body)) + body


def test_aiff_formats():
    x = np.array([[0.5, -0.25], [-1.0, 0.75], [0.0, 0.125]])
    whole = lambda bits, kind: (x * 2.0 ** (bits - 1)).astype(kind).tobytes()
    b24 = b"".join(int(v).to_bytes(3, "big", signed=True) for v in (x * 2.0**23).ravel())
    files = [aiff(whole(8, "i1"), 2, 8), aiff(whole(16, ">i2"), 2, 16), aiff(whole(16, "<i2"), 2, 16, b"sowt"), aiff(b24, 2, 24), aiff(whole(32, ">i4"), 2, 32, b"NONE"), aiff(x.astype(">f4").tobytes(), 2, 32, b"fl32"), aiff(x.astype(">f8").tobytes(), 2, 64, b"FL64")]
    for data in files:
        y, channels, rate = audio.decode_aiff(data)
        assert (y.reshape(-1, 2) == x).all() and (channels, rate) == (2, 44100)
    cut = files[1][:-4]
    assert len(audio.decode_to_mono(cut)[0]) == 2
    for data, limits, code in ((cut, DecodeLimits(integrity_mode=True), errors.BAD_IO), (files[1], DecodeLimits(max_samples=2), errors.TOO_LARGE), (aiff(b"", 1, 16, b"MAC3"), DecodeLimits(), errors.BAD_IO), (files[1][:30], DecodeLimits(), errors.BAD_IO), (aiff(b"", 1, 16).replace(b"\0\1\0\0\0\0\0\x10", b"\0\0\0\0\0\0\0\x10"), DecodeLimits(), errors.BAD_CHANNELS)):
        with pytest.raises(audio.DecodeError) as e:
            audio.decode_to_mono(data, limits)
        assert e.value.code == code


def test_companded_values():
    codes = bytes([0x00, 0x80, 0xFF, 0x7F, 0x55, 0xD5, 0x2A, 0xAA])
    assert (formats.mu_law(codes) * 32768).astype(int).tolist() == [-32124, 32124, 0, 0, -716, 716, -5372, 5372]
    assert (formats.a_law(codes) * 32768).astype(int).tolist() == [-5504, 5504, 848, -848, -8, 8, -32256, 32256]
    every = bytes(range(256))
    for law in (formats.mu_law, formats.a_law):
        assert sorted(-law(every)) == sorted(law(every)) and np.abs(law(every)).max() < 1


def ima_wav(raw: bytes, align: int, channels: int) -> bytes:
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 0x11, channels, 8000, 8000, align, 4) + b"data" + struct.pack("<I", len(raw))
    return b"RIFF" + struct.pack("<I", len(head) + len(raw)) + head + raw


def plain_ima(block: bytes, channels: int) -> list[list[int]]:
    """Samples of each channel of one block, code by code."""
    out = []
    for c in range(channels):
        value, place = struct.unpack("<hB", block[4 * c : 4 * c + 3])
        got, body = [value], block[4 * channels :]
        for word in range(len(body) // (4 * channels)):
            for byte in body[4 * (word * channels + c) :][:4]:
                for code in (byte & 15, byte >> 4):
                    step = formats.IMA_STEPS[place]
                    size = step // 8 + (step // 4 if code & 1 else 0) + (step // 2 if code & 2 else 0) + (step if code & 4 else 0)
                    value = max(-32768, min(32767, value - size if code & 8 else value + size))
                    place = max(0, min(88, place + formats.IMA_MOVES[code & 7]))
                    got.append(value)
        out.append(got)
    return out


@pytest.mark.parametrize("channels", [1, 2])
def test_ima_adpcm_equals_a_plain_decoder(channels, monkeypatch):
    rng, align = np.random.default_rng(3), 4 * channels * 6
    blocks = [b"".join(struct.pack("<hBB", rng.integers(-32768, 32767), rng.integers(0, 89), 0) for _ in range(channels)) + rng.bytes(align - 4 * channels) for _ in range(9)]
    blocks.append(blocks[0][: 4 * channels * 3])
    want = np.concatenate([np.array(plain_ima(b, channels)).T for b in blocks])
    monkeypatch.setattr(formats, "PACKET_BLOCKS", 4)
    y, n, rate = audio.decode_wav(ima_wav(b"".join(blocks), align, channels))
    assert (y.reshape(-1, channels) * 32768 == want).all() and (n, rate) == (channels, 8000)
    assert formats.ima_frames(sum(map(len, blocks)), align, channels) == len(want)
    # a packet that can't be decoded is skipped; in integrity mode it is an error, as is a word that is cut off
    broken = ima_wav(b"".join([blocks[0], blocks[1][:2] + b"\x59" + blocks[1][3:], *blocks[2:]]), align, channels)
    assert (audio.decode_wav(broken)[0].reshape(-1, channels) * 32768 == np.delete(want, slice(41, 82), 0)).all()
    for data, limits, code in ((broken, DecodeLimits(integrity_mode=True), errors.BAD_IO), (ima_wav(b"".join(blocks)[:-1], align, channels), DecodeLimits(integrity_mode=True), errors.BAD_IO), (broken, DecodeLimits(max_samples=len(want) - 1), errors.TOO_LARGE)):
        with pytest.raises(audio.DecodeError) as e:
            audio.decode_wav(data, limits)
        assert e.value.code == code
    assert len(audio.decode_wav(ima_wav(b"".join(blocks)[:-1], align, channels))[0]) == (len(want) - 8) * channels
    ticks = iter(range(100))
    with pytest.raises(audio.DecodeError) as e:  # the clock is read before every packet
        audio.decode_wav(broken, DecodeLimits(timeout=4), lambda: next(ticks))
    assert e.value.code == errors.TIMEOUT and next(ticks) == 6


def test_read_audio(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav(np.zeros(500)))
    (tmp_path / "big.wav").write_bytes(wav(np.zeros(5000)))
    (tmp_path / "c.wav").write_bytes(b"RIFF")
    rows = {r.recording_id.rsplit("/", 1)[1]: r for r in audio.read_audio(spark, str(tmp_path), limits=DecodeLimits(max_bytes=3000)).collect()}
    assert len(rows["a.wav"].samples) == 500 and rows["big.wav"].error.code == errors.TOO_LARGE and rows["c.wav"].error.code == errors.BAD_IO


def test_blob_round_trip(spark):
    rows = [("a", 4294967295, 3), ("a", 7, 3), ("a", 9, 1), ("b", 5, 0)]
    table = spark.createDataFrame(rows, "recording_id string, hash bigint, t_anchor bigint")
    packed = blobs.write_blobs(table, "wang-v1", 62.5)
    back = blobs.read_blobs(packed, "wang-v1").collect()
    assert [(r.recording_id, r.hash, r.t_anchor) for r in back if r.recording_id == "a"] == [("a", 9, 1), ("a", 7, 3), ("a", 4294967295, 3)]
    head = {r.recording_id: r for r in blobs.peek(packed).collect()}
    assert (head["a"].algorithm, head["a"].hash_count, head["a"].frames_per_sec, head["a"].sample_rate, head["a"].error) == ("wang-v1", 3, 62.5, 8000, None)


def test_bad_blobs(spark):
    good = blobs.pack(np.array([[1], [2]]), "haitsma-v1", 78.125)
    cases = {"short": good[:10], "magic": b"x" + good[1:], "version": good[:8] + b"\x02" + good[9:], "frame rate": good[:14] + struct.pack("<f", -1) + good[18:], "algorithm": good[:9] + b"\x09" + good[10:]}
    table = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()] + [("cut", bytearray(good[:-1])), ("nan", bytearray(good[:14] + struct.pack("<f", float("nan")) + good[18:])), ("tail", bytearray(good + b"zz"))], "recording_id string, blob binary")
    seen = {r.recording_id: r.error for r in blobs.peek(table).collect()}
    assert {k: seen[k] for k in cases} == {k: k for k in cases} and seen["nan"] == "frame rate" and seen["cut"] is None
    read = {}
    for r in blobs.read_blobs(table, "haitsma-v1").collect():
        read.setdefault(r.recording_id, []).append(r)
    assert all(read[k][0].error for k in [*cases, "cut", "nan"])
    assert [(r.pos, r.frame) for r in read["tail"]] == [(0, 1), (1, 2)]


def test_dtw_against_plain_recursion():
    rng = np.random.default_rng(0)
    q, r = rng.standard_normal((5, 4)), rng.standard_normal((7, 4))
    d = 1 - q @ r.T
    c = np.full((6, 8), np.inf)
    c[0, 0] = 0
    for i in range(1, 6):
        for j in range(1, 8):
            c[i, j] = d[i - 1, j - 1] + min(c[i - 1, j], c[i, j - 1], c[i - 1, j - 1])
    assert abs(dtw_cost(q, r) - c[5, 7]) < 1e-9
