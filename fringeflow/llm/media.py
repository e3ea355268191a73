"""Interleaved documents: ordered text and media references, with payloads resolved by digest.

HTML is parsed into one ordered sequence of items per page; payloads are kept once per digest in a
table of their own, as lossless 8-bit samples, and a join on the digest brings them back to the
items, whose positions and captions stay with them.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeflow.llm.store import materialize

#: Samples in a row of a stored image.
WIDTH = 64
#: Digests that a task remembers having stored.
_REMEMBERED = 500_000

_SKIP = {"script", "style", "noscript", "template"}
#: Skipped only where they are closed again.
_MAY_STAY_OPEN = ("noscript", "template")
_MAYBE_OPEN = re.compile(r"(?i)<(?:noscript|template)")
_BLOCK = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "table", "tr", "td", "th", "nav", "header", "footer", "figure", "figcaption", "blockquote", "pre", "title", "hr"}
_MEDIA = {"img", "video", "audio", "source", "embed"}
#: How a reference names a payload by its digest.
_BY_DIGEST = "digest:"
ITEM = "array<struct<position: int, kind: string, text: string, src: string, digest: string, caption: string>>"


class _Closed(HTMLParser):
    """Which of the <noscript> and <template> tags, by their place among them, are closed again."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.n, self.open, self.closed = 0, {t: [] for t in _MAY_STAY_OPEN}, set()

    def handle_starttag(self, tag, attrs):
        if tag in _MAY_STAY_OPEN:
            self.open[tag].append(self.n)
            self.n += 1

    def handle_endtag(self, tag):
        if self.open.get(tag):
            self.closed.add(self.open[tag].pop())


class _Items(HTMLParser):
    """Items in order. A figure's caption is held until the figure ends: it goes to all of its media, or stays as a text where there are none."""

    def __init__(self, closed: set[int]):
        super().__init__(convert_charrefs=True)
        self.items, self.text, self.closed, self.met = [], [], closed, 0
        self.skipped = {t: [] for t in _SKIP}  # for each open tag, whether its text is skipped
        self.figures = []  # of each open figure: its first item, captions (place, words), start of an open caption

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "src": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            skip = tag not in _MAY_STAY_OPEN or self.met in self.closed
            self.met += tag in _MAY_STAY_OPEN
            self.skipped[tag].append(skip)
        if tag in _BLOCK or tag in _MEDIA:
            self.flush()
        got = dict(attrs)
        if tag in _MEDIA and got.get("src"):
            self.items.append({"kind": tag, "text": None, "src": got["src"], "caption": got.get("alt") or got.get("title")})
        if tag == "figure":
            self.figures.append({"first": len(self.items), "captions": [], "open": None})
        if tag == "figcaption" and self.figures:
            self.end_caption()
            self.figures[-1]["open"] = len(self.items)

    def end_caption(self):
        f = self.figures[-1]
        if f["open"] is None:
            return
        inside = self.items[f["open"] :]
        words = " ".join(x["text"] for x in inside if x["kind"] == "text")
        self.items[f["open"] :] = [x for x in inside if x["kind"] != "text"]
        if words:
            f["captions"].append((f["open"], words))
        f["open"] = None

    def end_figure(self):
        self.end_caption()
        f = self.figures.pop()
        media = [x for x in self.items[f["first"] :] if x["kind"] != "text"]
        if media and f["captions"]:
            words = " ".join(w for _, w in f["captions"])
            for x in media:
                if not x.get("captioned"):  # by a figure inside this one
                    x["caption"], x["captioned"] = words, True
            if not any(x["caption"] == words for x in media):
                media = []
        if not media:
            for at, words in reversed(f["captions"]):
                self.items.insert(at, {"kind": "text", "text": words, "src": None, "caption": None})

    def handle_endtag(self, tag):
        if self.skipped.get(tag):
            self.skipped[tag].pop()
        if tag in _BLOCK:
            self.flush()
        if tag == "figcaption" and self.figures:
            self.end_caption()
        if tag == "figure" and self.figures:
            self.end_figure()

    def handle_data(self, data):
        if not any(map(any, self.skipped.values())):
            self.text.append(data)

    def finish(self):
        self.close()
        self.flush()
        while self.figures:
            self.end_figure()
        for x in self.items:
            x.pop("captioned", None)


def inline_payload(src: str) -> bytes | None:
    """The bytes of a data: reference; None for any other reference, or one that cannot be decoded."""
    head, comma, body = src.partition(",")
    if not comma or not head.lower().startswith("data:"):
        return None
    raw = unquote_to_bytes(body)
    if head.lower().endswith(";base64"):
        try:
            return base64.b64decode(raw, validate=True)
        except binascii.Error:
            return None
    return raw


def digest_of(src: str) -> str:
    """The digest that a reference names (digest:...), else that of its inline payload, else that of the reference itself."""
    if src.startswith(_BY_DIGEST):
        return src[len(_BY_DIGEST) :]
    inline = inline_payload(src)
    return hashlib.sha256(src.encode("utf-8", "surrogatepass") if inline is None else inline).hexdigest()


def parse(html: str | None) -> list[dict]:
    """Items in order; each media item with the digest of its reference."""
    if not html:
        return []
    closed = _Closed()
    if _MAYBE_OPEN.search(html):
        closed.feed(html)
        closed.close()
    p = _Items(closed.closed)
    p.feed(html)
    p.finish()
    for i, x in enumerate(p.items):
        x["position"], x["digest"] = i, None
        if x["src"]:
            x["digest"] = digest_of(x["src"])
    return p.items


def interleave(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, items) for every row of pages; null, empty and tagless html give no, no and one item."""
    kind = pa.list_(pa.struct([("position", pa.int32()), *((c, pa.string()) for c in ("kind", "text", "src", "digest", "caption"))]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parse(h) for h in b.column(1).to_pylist()], kind)], ["page_id", "items"])

    return pages.select(F.col(id_col), F.col(html_col).cast("string")).mapInArrow(read, f"page_id {dict(pages.dtypes)[id_col]}, items {ITEM}")


def resolve(sequences: DataFrame, payloads: DataFrame, unique: bool = False) -> DataFrame:
    """sequences(..., items) and payloads(digest, ...): an item a row, with its payload's columns, or nulls where none is known.

    payloads may repeat a digest, unless it is said to be unique: the first value of each column is taken. Text
    items have no payload.
    """
    own = [c for c in sequences.columns if c != "items"]
    items = sequences.select(*own, F.explode("items").alias("item")).select(*own, "item.*")
    one, cols = payloads.where(F.col("digest").isNotNull()), [c for c in payloads.columns if c != "digest"]
    if not unique:
        one = one.groupBy("digest").agg(*(F.first(c, ignorenulls=True).alias(c) for c in cols))
    return items.join(one, "digest", "left").select(*own, "position", "kind", "text", "src", "caption", "digest", *cols)


def padded(text: bytes | None) -> bytes:
    """The text and zero bytes up to a positive multiple of WIDTH."""
    text = text or b""
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def to_samples(payload: bytes) -> bytes:
    """The payload as a grey image of 8-bit samples (PGM), WIDTH samples a row."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_samples(media: bytes) -> bytes:
    magic, shape, depth, samples = media.split(b"\n", 3)
    width, height = map(int, shape.split())
    if (magic, depth) != (b"P5", b"255") or len(samples) != width * height:
        raise ValueError("not an 8-bit grey image of its stated size")
    return samples


def feature(payload: bytes) -> str:
    """Size, mean and deviation in thousandths, and share (in thousandths) of each quarter of the sample range."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    n, level = len(x), np.arange(256)
    total, squares = int(counts @ level), int(counts @ (level * level))
    quarters = counts.reshape(4, 64).sum(axis=1) * 1000 // n
    return f"{WIDTH}x{n // WIDTH};mean={total * 1000 // n};var={(squares * n - total * total) // (n * n)};quarters={'/'.join(map(str, quarters))}"


_FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def as_page(text: str | None, digest: str, n_bytes: int) -> str:
    """A page that shows the stored text, with its size as caption, before what the text itself holds."""
    return f'<figure><img src="{_BY_DIGEST}{digest}"><figcaption>{n_bytes} bytes</figcaption></figure>{text or ""}'


#: What a document's result says of each of its items.
SEQUENCE = "array<struct<position: int, kind: string, chars: long, digest: string, caption: string>>"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The texts as pages with media: (row, doc_id, n_bytes, n_items, items, sequence) a row each, and the written table (digest, media, size).

    items are the page's media, sequence is all of its items without their texts. Stored are each text and each payload that a text holds inline, of which
    size is the number of bytes (null: all). One pass writes both tables; a digest is stored at least once, by each task that meets it.
    """
    kind = pa.list_(pa.struct([("position", pa.int32()), *((c, pa.string()) for c in ("kind", "text", "src", "digest", "caption"))]))
    short = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("chars", pa.int64()), ("digest", pa.string()), ("caption", pa.string())]))
    types = [pa.string(), pa.int64(), pa.int32(), kind, short, pa.string(), pa.binary(), pa.int64()]
    names = ["row", "n_bytes", "n_items", "items", "sequence", "digest", "media", "size"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        part, count = uuid.uuid4().hex, 0

        def new(d: bytes) -> bool:
            if len(seen) >= _REMEMBERED:
                seen.clear()
            known = d in seen
            seen.add(d)
            return not known

        for b in batches:
            out, inline = [], []
            for t, raw in zip(b.column(1).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                payload = padded(raw)
                d = hashlib.sha256(payload)
                n, count = len(raw or b""), count + 1
                sequence = parse(as_page(t, d.hexdigest(), n))
                told = [{"position": x["position"], "kind": x["kind"], "chars": len(x["text"]) if x["text"] is not None else None, "digest": x["digest"], "caption": x["caption"]} for x in sequence]
                out.append((f"{part}-{count}", n, len(sequence), [x for x in sequence if x["digest"]], told, d.hexdigest(), to_samples(payload) if new(d.digest()) else None, None))
                for x in sequence[1:]:
                    held = inline_payload(x["src"]) if x["src"] else None
                    if held is not None and new(bytes.fromhex(x["digest"])):
                        inline.append((None, None, None, None, None, x["digest"], to_samples(padded(held)), len(held)))
            ids = pa.concat_arrays([b.column(0), pa.nulls(len(inline), b.column(0).type)])
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[c] for x in out + inline], k) for c, k in enumerate(types))], ["doc_id", *names])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    stored = materialize(rows.mapInArrow(write, f"doc_id {dict(docs.dtypes)[id_col]}, row string, n_bytes long, n_items int, items {ITEM}, sequence {SEQUENCE}, digest string, media binary, size long"), "media")
    return stored.where(F.col("row").isNotNull()).select("row", "doc_id", "n_bytes", "n_items", "items", "sequence"), stored.where(F.col("media").isNotNull()).select("digest", "media", "size")


def features(payloads: DataFrame) -> DataFrame:
    """What the stored bytes say, by digest; fails where a payload does not have the digest it is stored under."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [[] for _ in range(6)]
            for d, m, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                samples = from_samples(m)
                payload = samples[:size]
                sha = hashlib.sha256(payload).hexdigest()
                if sha != d:
                    raise ValueError(f"stored payload {d} reads back as {sha}")
                for c, x in zip(cols, (len(payload), sha, zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(samples)), strict=True):
                    c.append(x)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, types)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return payloads.mapInArrow(read, _FEATURES)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_items: bool = False) -> DataFrame:
    """A row for each row of docs with what is read back from its stored media, the caption that stands with it, and how many items its page has.

    The text is an item sequence: a reference to its stored payload and then what the text holds if read as HTML.
    Null texts are empty ones (64 zero bytes). with_items adds `items`, in order: position, kind, characters of a text, digest and caption of a
    reference, and the bytes of the payload it resolves to: a text of docs that it names by digest, or one that it holds inline; null if neither.
    """
    sequences, payloads = store_texts(docs, id_col, text_col)
    # written first: the join then shuffles both sides itself, and may split a digest that very many items share
    one = materialize(features(payloads).dropDuplicates(["digest"]), "features")
    shown = sequences.drop("sequence").withColumn("items", F.filter("items", lambda x: x["position"] == 0))
    out = resolve(shown, one, unique=True)
    cols = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "caption", "n_items"]
    if not with_items:
        return out.select(*cols)
    # the other references of a text are few: only rows that have some are looked up again
    others = sequences.select("row", F.filter("items", lambda x: x["position"] > 0).alias("items")).where(F.size("items") > 0)
    found = resolve(others, one.select("digest", "payload_bytes"), unique=True).where(F.col("payload_bytes").isNotNull())
    found = found.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("position", "payload_bytes"))).alias("__found"))
    out = out.select("row", *cols).join(sequences.select("row", "sequence"), "row").join(found, "row", "left")
    size = lambda x: F.when(x["position"] == 0, F.col("payload_bytes")).otherwise(F.try_element_at("__found", x["position"]))
    items = F.transform("sequence", lambda x: F.struct(x["position"].alias("position"), x["kind"].alias("kind"), x["chars"].alias("chars"), x["digest"].alias("digest"), x["caption"].alias("caption"), size(x).alias("payload_bytes")))
    return out.select(*cols, items.alias("items"))
