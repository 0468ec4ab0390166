"""Compressed lengths under raw-content zstandard dictionaries."""

from __future__ import annotations

import zstandard


def compressor(content: bytes, level: int, **settings: int) -> zstandard.ZstdCompressor:
    """Compressor primed with ``content``; frames without magic, size, checksum or dictionary id, so that lengths
    tell the payload's cost. ``settings`` replace the level's own."""
    chosen = zstandard.ZstdCompressionParameters.from_level(
        level, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0, **settings
    )
    primed = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(compression_params=chosen)
    return zstandard.ZstdCompressor(dict_data=primed, compression_params=chosen)
