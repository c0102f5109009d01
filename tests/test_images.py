"""Headers of generated images, files of all kinds, and an engine of a task."""

import json
import struct
import zlib

from docloom.operators import geometry
from docloom.sources import images


def png(w, h, ppm=None):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = zlib.compress(b"".join(b"\0" + b"\xff" * w for _ in range(h)))
    physical = chunk(b"pHYs", struct.pack(">IIB", *ppm, 1)) if ppm else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + physical + chunk(b"IDAT", rows) + chunk(b"IEND", b"")


def tiff(w, h, dpi=None, order="<", unit=2):
    tags = [(256, 4, struct.pack(order + "I", w)), (257, 3, struct.pack(order + "HH", h, 0))]
    at = 8 + 2 + 12 * (len(tags) + 3) + 4
    if dpi:
        tags += [(282, 5, struct.pack(order + "I", at)), (283, 5, struct.pack(order + "I", at)), (296, 3, struct.pack(order + "HH", unit, 0))]
    body = struct.pack(order + "H", len(tags)) + b"".join(struct.pack(order + "HHI", t, k, 1) + v for t, k, v in tags) + struct.pack(order + "I", 0)
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    return (head + body).ljust(at, b"\0") + struct.pack(order + "II", int((dpi or 0) * 10), 10)


def jpeg(w, h, unit=None, density=(0, 0), exif=None):
    segment = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + (segment(0xE0, b"JFIF\0\x01\x01" + struct.pack(">BHH", unit, *density) + b"\0\0") if unit is not None else b"")
    out += segment(0xE1, b"Exif\0\0" + exif) if exif else b""
    return out + segment(0xDB, b"\0" * 65) + b"\xff" + segment(0xC2, struct.pack(">BHHB", 8, h, w, 3) + b"\0" * 9) + b"\xff\xd9"


def test_headers():
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 30, -20) + b"\0" * 12 + struct.pack("<ii", 3937, 3937)
    near = lambda found: None if found is None else (*found[:2], *(x and round(x, 1) for x in found[2:]))
    good = {
        png(12, 8): (12, 8, None, None),
        png(1200, 800, (11811, 5906)): (1200, 800, 300.0, 150.0),
        tiff(70, 50, 300): (70, 50, 300.0, 300.0),
        tiff(70, 50, 118.1, ">", 3): (70, 50, 300.0, 300.0),
        tiff(7, 5): (7, 5, None, None),
        jpeg(640, 480): (640, 480, None, None),
        jpeg(640, 480, 1, (96, 72)): (640, 480, 96.0, 72.0),
        jpeg(640, 480, 2, (100, 100)): (640, 480, 254.0, 254.0),
        jpeg(640, 480, 0, (1, 1), tiff(1, 1, 200)): (640, 480, 200.0, 200.0),
        bmp: (30, 20, 100.0, 100.0),
    }
    assert [(near(images.header(data)[0]), images.header(data)[1]) for data in good] == [(want, None) for want in good.values()]
    assert [images.header(x)[1] for x in (b"", b"GIF89a", png(5, 5)[:20], jpeg(5, 5)[:12], tiff(5, 5)[:20], b"BM12", png(0, 4))] == ["unknown_format", "unknown_format", "truncated", "truncated", "truncated", "truncated", "no_size"]


def test_files_and_an_engine(spark, tmp_path, monkeypatch):
    class Recorder:
        """An engine that writes what happens to it."""

        def __init__(self, log):
            self.log = log
            self._say("open")

        def _say(self, what):
            with open(self.log, "a") as f:
                f.write(what + "\n")

        def read(self, content, suffix):
            if len(content) % 2:
                raise ValueError("odd")
            self._say("read")
            return [{"rec_texts": [suffix], "rec_scores": [1], "rec_polys": [[0, 0, 5, 5]]}]

        def close(self):
            self._say("close")

    folder = tmp_path / "pages"
    folder.mkdir()
    even = lambda data: data + b"\0" * (len(data) % 2)
    for name, data in {"a.PNG": even(png(9, 9)), "b.webp": even(png(8, 8, (11811, 11811))), "c.jpeg": even(jpeg(7, 7)) + b"\0", "d": even(tiff(6, 6, 100)), "e.tif": tiff(6, 6)[:9], "f.bmp": b"x" * 3000}.items():
        (folder / name).write_bytes(data)
    monkeypatch.setattr(images, "MAX_BYTES", 2999)
    files = images.page_images(spark, str(folder)).coalesce(1)
    name = lambda r: r.path.rsplit("/", 1)[1]
    assert {name(r): (r.suffix, r.error) for r in files.collect()} == {"a.PNG": ("png", None), "b.webp": ("png", None), "c.jpeg": ("jpeg", None), "d": ("png", None), "e.tif": ("tif", None), "f.bmp": ("bmp", "too_large")}
    sizes = {name(r): (r.width, r.height, r.dpi_x and round(r.dpi_x), r.error) for r in images.headers(files).collect()}
    assert sizes == {"a.PNG": (9, 9, 300, None), "b.webp": (8, 8, 300, None), "c.jpeg": (7, 7, 300, None), "d": (6, 6, 100, None), "e.tif": (None, None, None, "truncated"), "f.bmp": (None, None, None, "too_large")}
    log = str(tmp_path / "log")
    read = images.read_images(files, lambda: Recorder(log)).collect()
    assert {name(r): r.error for r in read} == {"a.PNG": None, "b.webp": None, "c.jpeg": "engine_failed: ValueError", "d": None, "e.tif": "truncated", "f.bmp": "too_large"}
    assert open(log).read().split() == ["open", "read", "read", "read", "close"]
    assert json.loads(next(r.raw for r in read if name(r) == "d"))["dpi"] == [100.0, 100.0]
    pages = geometry.read_pages(spark.createDataFrame(read, "path string, raw string, e string").filter("raw IS NOT NULL"), ["path"])
    rows = geometry.element_rows(pages, ["path"]).collect()
    assert {(name(r), r.text) for r in rows if r.text} == {("a.PNG", "png"), ("b.webp", "png"), ("d", "png")}
