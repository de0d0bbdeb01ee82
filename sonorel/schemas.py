"""Explicit schemas of all tables. Unsigned 32-bit hashes are BIGINT; times in frames are BIGINT."""

from __future__ import annotations

ERROR = "struct<code:string,detail:string>"
RECORDINGS = "recording_id string, sample_rate int, samples array<float>"
PCM_CHUNKS = "stream_id string, seq bigint, samples array<float>, eos boolean"
PEAKS = "recording_id string, t bigint, f bigint, mag float"
WANG_HASHES = "recording_id string, hash bigint, t_anchor bigint"
PANAKO_HASHES = "recording_id string, hash bigint, t_anchor bigint, t_b bigint, t_c bigint"
HAITSMA_FRAMES = "recording_id string, pos bigint, frame bigint"
EMBEDDINGS = "recording_id string, idx bigint, t_ms bigint, vector array<float>"
OFFSET = "struct<frames:bigint,ms:bigint>"
MATCH = f"is_match boolean, score double, votes bigint, prominence double, offset {OFFSET}, time_scale double"
WATERMARKS = f"recording_id string, detected boolean, confidence float, message bigint, localization array<float>, error {ERROR}"
