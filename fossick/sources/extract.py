"""Texts and properties of files by kind: an extractor is a function from bytes to text, found by the extension.

Office files are read with the standard library: they are zipped XML. PDF has no reader here; register one with
``EXTRACTORS["pdf"] = function`` and it runs where the others do.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from html import unescape
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fossick.functions.text import extension

_SKIPPED = re.compile(r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->")


def encoding_of(raw: bytes) -> str:
    """By its mark, else UTF-16 if every other byte is mostly zero, else UTF-8 if it is that, else Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\0\0", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return name
    half = len(raw) // 2
    if half and raw[1::2].count(0) > 0.4 * half:
        return "utf-16-le"
    if half and raw[::2].count(0) > 0.4 * half:
        return "utf-16-be"
    try:
        raw.decode()
        return "utf-8"
    except UnicodeDecodeError as e:
        # a head may be cut inside a character
        return "utf-8" if e.reason == "unexpected end of data" and len(raw) - e.start < 4 else "latin-1"


def plain(raw: bytes) -> str:
    return raw.decode(encoding_of(raw), "replace")


def html(raw: bytes) -> str:
    return re.sub(r"\s+", " ", unescape(re.sub("<[^>]*>", " ", _SKIPPED.sub(" ", plain(raw))))).strip()


def _parts(raw: bytes, pattern: str) -> Iterator[ElementTree.Element]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = [n for n in z.namelist() if re.fullmatch(pattern, n)]
        for n in sorted(names, key=lambda n: [int(x) for x in re.findall(r"\d+", n)]):
            yield ElementTree.fromstring(z.read(n))


def _runs(root: ElementTree.Element, paragraph: str, run: str) -> list[str]:
    return ["".join(t.text or "" for t in p.iter() if t.tag.endswith("}" + run)) for p in root.iter() if p.tag.endswith("}" + paragraph)]


def docx(raw: bytes) -> str:
    return "\n".join(x for root in _parts(raw, r"word/document\.xml") for x in _runs(root, "p", "t"))


def pptx(raw: bytes) -> str:
    return "\n\n".join("\n".join(_runs(root, "p", "t")) for root in _parts(raw, r"ppt/slides/slide\d+\.xml"))


def xlsx(raw: bytes) -> str:
    shared = [x for root in _parts(raw, r"xl/sharedStrings\.xml") for x in _runs(root, "si", "t")]
    sheets = []
    for root in _parts(raw, r"xl/worksheets/sheet\d+\.xml"):
        rows = []
        for row in root.iter():
            if row.tag.endswith("}row"):
                cells = []
                for c in row:
                    v = next((x.text or "" for x in c.iter() if x.tag.endswith("}v")), None)
                    cells.append("".join(_runs(c, "is", "t")) if v is None else shared[int(v)] if c.get("t") == "s" else v)
                rows.append("\t".join(cells))
        sheets.append("\n".join(rows))
    return "\n\n".join(sheets)


EXTRACTORS: dict[str, Callable[[bytes], str]] = {"html": html, "htm": html, "docx": docx, "pptx": pptx, "xlsx": xlsx}


def image_size(raw: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG, GIF, BMP or JPEG file."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return struct.unpack(">II", raw[16:24])
    if raw[:4] == b"GIF8" and len(raw) >= 10:
        return struct.unpack("<HH", raw[6:10])
    if raw[:2] == b"BM" and len(raw) >= 26:
        w, h = struct.unpack("<ii", raw[18:26])
        return w, abs(h)
    i = 2
    while raw[:2] == b"\xff\xd8" and i + 9 <= len(raw) and raw[i] == 0xFF:
        if 0xC0 <= raw[i + 1] <= 0xCF and raw[i + 1] not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", raw[i + 5 : i + 9])
            return w, h
        i += 2 + struct.unpack(">H", raw[i + 2 : i + 4])[0]
    return None


def extracted(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, content, width, height, problem) of files (path, content binary), by extension; without an extractor bytes
    count as text. What can't be read has a null content and the reason in ``problem``. A narrow pass."""
    how = dict(EXTRACTORS if extractors is None else extractors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                b = whole.slice(i, 64)
                rows = []
                for kind, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    try:
                        size = image_size(raw or b"")
                        text = None if raw is None or size else how.get(kind, plain)(raw)
                        rows.append((text, *(size or (None, None)), None))
                    except Exception as e:  # noqa: BLE001 a broken file must not end the scan
                        rows.append((None, None, None, f"{type(e).__name__}: {e}"[:200]))
                text, w, h, why = zip(*rows, strict=True)
                yield pa.record_batch([b.column(0), pa.array(text, pa.string()), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(why, pa.string())], ["path", "content", "width", "height", "problem"])

    src = files.select("path", extension(F.col("path")).alias("kind"), F.col("content").cast("binary").alias("content"))
    return src.mapInArrow(run, "path string, content string, width int, height int, problem string")
