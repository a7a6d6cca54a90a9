"""Secret scans through a recursive decoding worklist.

Every text starts as one layer on a worklist. A layer is scanned by all rules; then each encoding found in it gives
child layers: URL and Unicode escapes rewrite the whole layer, a base64 run gives its decoded text or bytes, and gzip,
zlib, bzip2, xz or Zstandard bytes give what all their members hold. Bytes that are neither these nor text in UTF-8 are
read as Latin-1, and as UTF-16 where that can hold a secret. Children go on the list unless a layer of their own chain has the
same content (cycle detection); the list runs empty at the fixpoint. Every layer maps spans to its parent's, so a finding
carries its span in the original text. Content that stands at several places is worked through once: what was found in
it is mapped to each of them.

A compressed layer of more than ``MOST_BYTES`` is reported as ``oversized_layer`` and unpacked in windows of ``WINDOW``
bytes, of which each holds the last ``OVERLAP`` of the one before; every window is scanned like a text of its own, so
memory stays bounded and only what is encoded over more than the overlap may be cut.

Defined results: a null or empty text has no findings; a null id is carried along; repeated rows are each reported; the
same secret found again through another layer at the same span is one finding, with the shortest chain of layers;
different secrets of one span, such as those of a compressed layer, are each reported.
"""

from __future__ import annotations

import base64
import bisect
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fossick.llm.common import bound_batches, col, slices

#: Most bytes that one compressed layer may unpack to at once; a larger one is unpacked in windows.
MOST_BYTES = 64 << 20
WINDOW, OVERLAP = 8 << 20, 64 << 10
#: Characters of the shortest string that a rule matches.
LEAST_SECRET = 12
#: Shortest base64 run that is decoded, without its pads.
LEAST_RUN = 16

RULES: dict[str, str] = {
    "aws_access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "github_token": r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}",
    "slack_token": r"(?<![A-Za-z0-9])xox[abposr]-[A-Za-z0-9-]{10,}",
    "google_api_key": r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_-]{35}",
    "private_key": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----",
    "json_web_token": r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+",
    "assigned_secret": r"(?i:(?<![a-z])(?:api[_-]?key|token|secret|password|passwd|pwd|access[_-]?key))[\"']?[ \t]{0,8}[:=][ \t]{0,8}[\"']?[A-Za-z0-9+/_.~-]{8,}",
}
#: What a text that matches a rule holds, in lower case: looking for it takes a fraction of the time of the rules.
_MARKS = {"aws_access_key": ("akia", "asia"), "github_token": ("gh",), "slack_token": ("xox",), "google_api_key": ("aiza",), "private_key": ("private key-----",), "json_web_token": ("eyj",), "assigned_secret": ("key", "token", "secret", "passw", "pwd")}


@cache
def _rules(names: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?P<{k}>{RULES[k]})" for k in names))


def _direct(text: str) -> list[tuple[str, int, int, str]]:
    """(rule, start, end, hash) of the secrets that stand in a text."""
    low = text.lower()
    names = tuple(k for k in RULES if any(m in low for m in _MARKS[k]))
    return [(m.lastgroup, *m.span(), _sha(m.group())) for m in _rules(names).finditer(text)] if names else []


#: A text that this doesn't find has neither secret nor layer: built-in filter ahead of Python. Java syntax.
CANDIDATE = (
    rf"%[0-9A-Fa-f]{{2}}|\\u[0-9A-Fa-f]{{4}}|\\x[0-9A-Fa-f]{{2}}|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST_RUN}}}|AKIA|ASIA|gh[pousr]_|xox[abposr]-|AIza|PRIVATE KEY-----|eyJ"
    r"|(?i:key|token|secret|passw(?:or)?d|pwd)[\"']?[ \t]{0,8}[:=]"
)
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+")
_BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-])(?:(?:[A-Za-z0-9+/]{{60,76}}\r?\n)+[A-Za-z0-9+/]{{1,76}}|[A-Za-z0-9+/_-]{{{LEAST_RUN},}})={{0,2}}")
_COMMON = re.compile(r"[\t\n\r -~]+")
_MAGIC = ((b"\x1f\x8b", "gzip"), (b"x\x01", "zlib"), (b"x\x5e", "zlib"), (b"x\x9c", "zlib"), (b"x\xda", "zlib"), (b"\x28\xb5\x2f\xfd", "zstd"), (b"BZh", "bzip2"), (b"\xfd7zXZ\x00", "xz"))

Span = tuple[int, int]
Mapper = Callable[[int, int], Span]


def _rewrite(text: str, pattern: re.Pattern, decode: Callable[[str], str]) -> tuple[str, Mapper] | None:
    """The text with every match decoded, and the map of its spans to those of ``text``."""
    out, at, pieces, size = [], 0, [(0, 0, 0)], 0  # (where a piece begins, where in text, length there of an escape or -1)
    for m in pattern.finditer(text):
        new = decode(m.group())
        if new == m.group():
            continue
        pieces.append((size, at, -1))
        out.append(text[at : m.start()])
        size += m.start() - at
        pieces.append((size, m.start(), m.end() - m.start()))
        out.append(new)
        size += len(new)
        at = m.end()
    if not at:
        return None
    pieces.append((size, at, -1))
    out.append(text[at:])
    begins = [p[0] for p in pieces]

    def mapper(s: int, e: int) -> Span:
        a = pieces[bisect.bisect_right(begins, s) - 1]
        b = pieces[bisect.bisect_right(begins, max(s, e - 1)) - 1]
        return a[1] + (s - a[0] if a[2] < 0 else 0), b[1] + (e - b[0] if b[2] < 0 else b[2])

    return "".join(out), mapper


def _url(s: str) -> str:
    try:
        return bytes.fromhex(s.replace("%", "")).decode()
    except UnicodeDecodeError:
        return bytes.fromhex(s.replace("%", "")).decode("latin-1")


def _unicode(s: str) -> str:
    units = [int(x[1:], 16) for x in re.findall(r"[ux][0-9A-Fa-f]+", s)]
    return b"".join(u.to_bytes(2, "little") for u in units).decode("utf-16-le", "replace")


def _debase(run: str) -> bytes | None:
    s = re.sub(r"[\r\n=]", "", run).replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        s = s[:-1]
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4))
    except (binascii.Error, ValueError):
        return None


def _magic(b: bytes) -> str | None:
    return next((kind for head, kind in _MAGIC if b.startswith(head)), None)


def _member(b: bytes, kind: str, most: int) -> tuple[bytes, bytes]:
    """What the first member of compressed bytes holds, as far as it is whole, and the bytes behind it."""
    if kind == "zstd":
        d, out, size = zstandard.ZstdDecompressor().decompressobj(), [], 0
        # a kilobyte unpacks to some megabytes at most
        for i in range(0, len(b), 1024):
            out.append(d.decompress(b[i : i + 1024]))
            size += len(out[-1])
            if d.eof or size > most:
                return b"".join(out), d.unused_data + b[i + 1024 :]
        return b"".join(out), b""
    d = {"gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj, "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}[kind]()
    return d.decompress(b, most), d.unused_data if d.eof else b""


def _unpack(b: bytes, kind: str) -> bytes | None:
    """What all members of compressed bytes hold, as far as they are whole; None if it isn't that kind after all; may raise
    OverflowError. Members may be of different kinds and padded with zeros."""
    out, size, rest, first = [], 0, b, True
    next_: str | None = kind
    while next_:
        try:
            part, rest = _member(rest, next_, MOST_BYTES + 1 - size)
        except (zlib.error, zstandard.ZstdError, OSError, EOFError, lzma.LZMAError, ValueError):
            if first:
                return None
            break
        out.append(part)
        size += len(part)
        if size > MOST_BYTES:
            raise OverflowError
        rest = rest.lstrip(b"\0")
        next_, first = _magic(rest), False
    return b"".join(out) or None


def _stream(b: bytes, kind: str | None) -> Iterator[bytes]:
    """What all members of compressed bytes hold, some megabytes at a time, as far as they are whole."""
    piece = 1 << 20
    while kind:
        try:
            if kind == "zstd":
                d, i = zstandard.ZstdDecompressor().decompressobj(), 0
                while i < len(b) and not d.eof:
                    yield d.decompress(b[i : i + 1024])
                    i += 1024
                b = d.unused_data + b[i:] if d.eof else b""
            elif kind in ("gzip", "zlib"):
                d = zlib.decompressobj(31 if kind == "gzip" else 15)
                while b and not d.eof:
                    yield d.decompress(b, piece)
                    b = d.unconsumed_tail
                b = d.unused_data
            else:
                d, give = {"bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}[kind](), b
                while not d.eof and (give or not d.needs_input):
                    yield d.decompress(give, piece)
                    give = b""
                b = d.unused_data
        except (zlib.error, zstandard.ZstdError, OSError, EOFError, lzma.LZMAError, ValueError):
            return
        b = b.lstrip(b"\0")
        kind = _magic(b)


def _windows(b: bytes, kind: str) -> Iterator[str]:
    """The layer's text, window by window."""
    held = bytearray()
    for part in _stream(b, kind):
        held += part
        while len(held) >= WINDOW:
            yield bytes(held[:WINDOW]).decode("utf-8", "replace")
            del held[: WINDOW - OVERLAP]
    if held:
        yield bytes(held).decode("utf-8", "replace")


def _as_text(b: bytes) -> str | None:
    """Bytes as text if they are UTF-8 and nearly all of it can be printed."""
    try:
        s = b.decode()
    except UnicodeDecodeError:
        return None
    if s.isprintable():
        return s or None
    odd = sum(not c.isprintable() for c in _COMMON.sub("", s))
    return s if odd * 10 <= len(s) else None


class _Layer:
    """A layer's content, the secrets that stand in it, its child layers, and all that was found in it and in them."""

    def __init__(self, content: str | bytes, mark: bytes):
        self.content, self.mark = content, mark
        self.direct: list[tuple[str, int, int, str]] = []
        self.children: list[tuple[_Layer, str, Mapper]] = []
        self.found: dict[tuple[str, int, int, str], tuple[int, str]] = {}

    def report(self, key: tuple[str, int, int, str], new: tuple[int, str]) -> None:
        if key not in self.found or new < self.found[key]:
            self.found[key] = new


def _sha(secret: str) -> str:
    return hashlib.sha256(secret.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def _open(node: _Layer) -> tuple[list[tuple[str, int, int, str]], list[tuple[str | bytes, str, Mapper]]]:
    """The secrets that stand in a layer itself, and its child layers with their names and mappers."""
    layer, out = node.content, []
    if isinstance(layer, bytes):
        kind = _magic(layer)
        try:
            inner = _unpack(layer, kind) if kind else None
        except OverflowError:
            for window in _windows(layer, kind):
                for rule, _, _, chain, sha in scan_text(window):
                    chain = f"{kind}>{chain}" if chain else kind
                    node.report((rule, 0, 1, sha), (chain.count(">") + 1, chain))
            return [("oversized_layer", 0, 1, _sha(node.mark.hex()))], []
        if inner is not None:
            out.append((_as_text(inner) or inner, kind, lambda s, e: (0, 1)))
        else:
            out.append((layer.decode("latin-1"), "latin-1", lambda s, e: (s, e)))
            # a secret in UTF-16 has a zero for each of its characters
            if layer.count(0) >= LEAST_SECRET:
                for name in ("utf-16-le", "utf-16-be"):
                    out.append((layer.decode(name, "replace"), name, lambda s, e: (0, len(layer))))
        return [], out
    for name, mark, pattern, decode in (("url", "%", _URL, _url), ("unicode", "\\", _UNICODE, _unicode)):
        if mark in layer and (child := _rewrite(layer, pattern, decode)):
            out.append((child[0], name, child[1]))
    for m in _BASE64.finditer(layer):
        raw = _debase(m.group())
        if not raw:
            continue
        inner = _as_text(raw)
        s0, e0 = m.span()
        if inner is not None and inner.isascii() and "\n" not in m.group():
            out.append((inner, "base64", lambda s, e, s0=s0, e0=e0: (s0 + s // 3 * 4, min(e0, s0 - (-e // 3) * 4))))
        else:
            out.append((raw if inner is None else inner, "base64", lambda s, e, s0=s0, e0=e0: (s0, e0)))
    return _direct(layer), out


def scan_text(text: str | None) -> list[tuple[str, int, int, str, str]]:
    """(rule, start, end, layers, sha256 of the secret) of every finding; start and end are characters of ``text``."""
    if not text:
        return []
    nodes: dict[tuple[bool, bytes], _Layer] = {}

    def layer(content: str | bytes) -> _Layer:
        mark = hashlib.blake2b(content if isinstance(content, bytes) else content.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        key = (isinstance(content, bytes), mark)
        if key not in nodes:
            nodes[key] = _Layer(content, mark)
            fresh.append(nodes[key])
        return nodes[key]

    fresh: deque[_Layer] = deque()
    top = layer(text)
    while fresh:
        node = fresh.popleft()
        node.direct, children = _open(node)
        node.children = [(layer(content), name, mapper) for content, name, mapper in children]
        node.content = ""
    # what a layer holds is known once all its children are, so they come first; a layer inside itself adds nothing new
    done: set[int] = set()
    work = [(top, False)]
    open_: set[int] = set()
    while work:
        node, ready = work.pop()
        if not ready:
            if id(node) in done or id(node) in open_:
                continue
            open_.add(id(node))
            work.append((node, True))
            work += [(child, False) for child, _, _ in node.children]
            continue
        for rule, s, e, sha in node.direct:
            node.report((rule, s, e, sha), (0, ""))
        for child, name, mapper in node.children:
            if id(child) in done:
                for (rule, s, e, sha), (n, chain) in child.found.items():
                    node.report((rule, *mapper(s, e), sha), (n + 1, f"{name}>{chain}" if chain else name))
        open_.discard(id(node))
        done.add(id(node))
    return sorted((rule, s, e, chain, sha) for (rule, s, e, sha), (_, chain) in top.found.items())


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a finding: doc_id, rule, start, end (characters of the text, end not included), layers, depth, secret_sha.

    A narrow pass: a built-in filter leaves the texts that can hold anything to Python.
    """
    bound_batches(docs.sparkSession)
    src = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text")).where(F.col("text").rlike(CANDIDATE))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            at, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for r in scan_text(t):
                    at.append(i)
                    rows.append(r)
            if rows:
                rule, s, e, chain, sha = zip(*rows, strict=True)
                depth = [0 if not c else c.count(">") + 1 for c in chain]
                yield pa.record_batch([b.column(0).take(pa.array(at)), pa.array(rule), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(chain), pa.array(depth, pa.int32()), pa.array(sha)], ["doc_id", "rule", "start", "end", "layers", "depth", "secret_sha"])

    return src.mapInArrow(run, f"doc_id {kind}, rule string, start int, end int, layers string, depth int, secret_sha string")
