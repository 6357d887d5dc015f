"""Media columns: progressive JPEG files in and RGB tensors out, and bytes kept in JPEG coefficients.

A JPEG's samples pass through a rounded transform, so they can't carry bytes
without loss; its own unit, the quantised coefficient, can.  ``store`` writes a
text's bytes as the coefficients of a progressive colour file, 64 to a block, first
the luma blocks and then those of both chroma components, which have half the width;
``load`` reads them back from the file's scans, and takes its feature from the RGB
tensor of full resolution.

Edge cases: null and empty texts give one block of zero bytes; equal texts give equal
files and features, wherever they stand; an empty table gives no rows; a file
that isn't a progressive JPEG, or is null, gives null tensors in ``tensors``;
other columns pass through.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import jpeg
from . import text as T

BLOCK = 64
#: Byte that becomes the coefficient 0: letters then have small coefficients.
CENTRE = 96
#: MCUs below one another, at most.
SIDE = 8191
#: Blocks coded at a time.
CHUNK = 6000


def _fields(df: DataFrame) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]


def store_bytes(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A file for each run of bytes."""
    files, lengths = [], np.diff(offsets)
    blocks = np.maximum(1, -(-lengths // BLOCK))
    mcus = -(-blocks // jpeg.MCU)
    columns = -(-mcus // SIDE)
    rows = -(-mcus // columns)
    whole = columns * rows * jpeg.MCU
    bounds = np.concatenate([[0], np.cumsum(whole)])
    i = 0
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK, "right")) - 1)
        padded = np.zeros((int(bounds[j] - bounds[i])) * BLOCK, np.uint8)
        padded[T.ragged((bounds[i:j] - bounds[i]) * BLOCK, lengths[i:j])] = data[offsets[i] : offsets[j]]
        coefficients = padded.reshape(-1, BLOCK).astype(np.int32) - CENTRE
        coefficients[T.ragged(bounds[i:j] - bounds[i] + blocks[i:j], whole[i:j] - blocks[i:j])] = 0  # past the payload
        sizes = [(16 * c, 8 * r) for c, r in zip(columns[i:j].tolist(), rows[i:j].tolist(), strict=True)]
        files += jpeg.encode_colour(coefficients, bounds[i : j + 1] - bounds[i], sizes, [b"bytes %d" % n for n in lengths[i:j].tolist()])
        i = j
    return files


def load_bytes(images: list[jpeg.Image]) -> list[tuple[int, bytes]]:
    """Of each image, how many bytes it was given, and the padded payload."""
    out = []
    for image in images:
        n = int(image.comment.split()[1])
        payload = (image.blocks[: max(1, -(-n // BLOCK))] + CENTRE).astype(np.uint8)
        out.append((n, payload.tobytes()))
    return out


def store(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """Adds (or replaces) the text's bytes as a progressive JPEG file."""
    docs = docs.drop(media_col)
    names = docs.columns

    def run(batches):
        for batch in batches:
            files = store_bytes(*T.buffers(batch.column(names.index(text_col))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(files, pa.binary())], names=[*names, media_col])

    return docs.mapInArrow(run, ", ".join([*_fields(docs), f"`{media_col}` binary"]))


def features(images: list[jpeg.Image]) -> list[str]:
    """Of each image width, height, and for red, green and blue the sum, the sum of squares and the steps between neighbours: exact integers."""
    out, i = [], 0
    while i < len(images):
        j = i + 1
        while j < len(images) and images[j].width == images[i].width:
            j += 1
        pixels = jpeg.rgb(jpeg.stacked(images[i:j])).astype(np.int64)
        heights = np.array([x.height for x in images[i:j]])
        top = np.cumsum(heights) - heights
        down = np.zeros((len(pixels), 3), np.int64)
        down[1:] = np.abs(np.diff(pixels, axis=0)).sum(axis=1)
        down[top] = 0
        rows = np.concatenate([pixels.sum(axis=1), (pixels * pixels).sum(axis=1), np.abs(np.diff(pixels, axis=1)).sum(axis=1), down], axis=1)
        for image, sums in zip(images[i:j], np.add.reduceat(rows, top, axis=0).tolist(), strict=True):
            out.append(":".join(map(str, (image.width, image.height, *sums))))
        i = j
    return out


def load(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Reads the files back: sizes and fingerprints of payload and file, and the feature of the image."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            files, rows, i = batch.column(1).to_pylist(), [], 0
            while i < len(files):
                j, size = i + 1, len(files[i])
                while j < len(files) and size + len(files[j]) <= CHUNK * BLOCK:
                    size += len(files[j])
                    j += 1
                images = jpeg.decode(files[i:j])
                for file, (n, payload), found in zip(files[i:j], load_bytes(images), features(images), strict=True):
                    rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(file), hashlib.sha256(file).hexdigest(), found))
                i = j
            if not rows:
                continue
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            out = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select(id_col, media_col).mapInArrow(run, schema)


def tensors(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds (or replaces) ``height``, ``width`` and ``rgb``, the samples of the full-resolution tensor in row order."""
    media = media.drop("height", "width", "rgb")
    names = media.columns

    def one(raw: bytes | None):
        try:
            image = jpeg.decode([raw])[0]
            pixels = jpeg.rgb(image)
        except (ValueError, TypeError, KeyError, IndexError):
            return None, None, None
        return pixels.shape[0], pixels.shape[1], pixels.tobytes()

    def run(batches):
        for batch in batches:
            rows = [one(x) for x in batch.column(names.index(media_col)).to_pylist()]
            height, width, pixels = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(height, pa.int32()), pa.array(width, pa.int32()), pa.array(pixels, pa.binary())], names=[*names, "height", "width", "rgb"])

    return media.mapInArrow(run, ", ".join([*_fields(media), "height int, width int, rgb binary"]))
