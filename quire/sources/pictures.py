"""Images' sides and kinds from the first bytes of their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: JPEG markers that stand alone, and those among C0 to CF that don't begin a frame
ALONE, NO_FRAME = {0x01, *range(0xD0, 0xD8)}, {0xC4, 0xC8, 0xCC}
FOUND = "width int, height int, type string"


def _jpeg(data: bytes) -> tuple[int, int]:
    """Walks from marker to marker to the first frame header; raises where there is none."""
    at = 2
    while True:
        while data[at] != 0xFF:  # some writers leave bytes between segments
            at += 1
        while data[at] == 0xFF:
            at += 1
        mark, at = data[at], at + 1
        if mark in ALONE:
            continue
        if mark in (0xD9, 0xDA):
            raise ValueError("no frame before the scan")
        if 0xC0 <= mark <= 0xCF and mark not in NO_FRAME:
            data[at + 6]  # all of it is there, or an error
            return int.from_bytes(data[at + 5 : at + 7], "big"), int.from_bytes(data[at + 3 : at + 5], "big")
        at += max(int.from_bytes(data[at : at + 2], "big"), 2)


def _webp(data: bytes) -> tuple[int, int]:
    little = lambda a, b: int.from_bytes(data[a:b], "little")
    kind = data[12:16]
    if kind == b"VP8X":
        return little(24, 27) + 1, little(27, 30) + 1
    if kind == b"VP8L" and data[20] == 0x2F:
        bits = little(21, 25)
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8 " and data[23:26] == b"\x9d\x01\x2a":
        return little(26, 28) & 0x3FFF, little(28, 30) & 0x3FFF
    raise ValueError("no frame header")


def header(data: bytes | None) -> tuple[int, int, str | None]:
    """(width, height, PNG, GIF, WEBP or JPEG); (0, 0, None) for a file that can't be read so, cut short or null."""
    data = data or b""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR" and len(data) >= 24:
            return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big"), "PNG"
        if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
            return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), "GIF"
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
            return *_webp(data), "WEBP"
        if data[:2] == b"\xff\xd8":
            w, h = _jpeg(data)
            return (w, h, "JPEG") if w and h else (0, 0, None)
    except (IndexError, ValueError):
        pass
    return 0, 0, None


def with_headers(images: DataFrame, content: str = "content") -> DataFrame:
    """images with width, height and type, which replace columns of those names, and n_bytes, in place of their content."""
    keep = [c for c in images.columns if c not in (content, "width", "height", "type", "n_bytes")]
    rows = images.select(*keep, F.col(content).alias("__content"))
    names = [*keep, "width", "height", "type", "n_bytes"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(len(keep))
            found = [header(x.as_py()) for x in column]
            sizes = [0 if not x.is_valid else len(x.as_buffer()) for x in column]
            new = [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.string()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], names=names)

    fields = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(run, f"{fields}{FOUND}, n_bytes bigint")
