"""Synthetic marker captures: PNG files from the standard library, laid out as captures x cameras."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np

from tessella.functions import markers


def write_png(path: str, img: np.ndarray) -> None:
    """Gray PNG of values in 0 to 1."""
    a = np.clip(np.rint(img * 255), 0, 255).astype(np.uint8)
    raw = b"".join(b"\0" + row.tobytes() for row in a)

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0, 0, 0, 0)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def scene(ids: list[int], size: int = 640, cell: int = 18, contrast: float = 1.0, shift: int = 0) -> np.ndarray:
    """A light square image with one marker after another along its diagonal."""
    img = np.ones((size, size))
    side = cell * markers.CELLS
    for i, marker in enumerate(ids):
        at = 40 + i * (side + 60) + shift
        img[at : at + side, at : at + side] = markers.drawn(markers.dictionary(max(50, marker + 1))[marker], cell)
    return 0.5 + (img - 0.5) * contrast


def marker_captures(root: str, captures: int, cameras: int, contrast: float = 1.0) -> None:
    """root/capture_000/cam000/image.png ...: capture k shows markers 2k and 2k + 1, camera c sees them shifted by 3c pixels."""
    for k in range(captures):
        for c in range(cameras):
            folder = f"{root}/capture_{k:03d}/cam{c:03d}"
            os.makedirs(folder, exist_ok=True)
            write_png(f"{folder}/image.png", scene([2 * k, 2 * k + 1], contrast=contrast, shift=3 * c))
