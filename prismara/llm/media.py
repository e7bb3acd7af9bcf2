"""Media columns: payloads stored as samples, and documents as ordered sequences of text and media references."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut, done, join_hot, kept, shared_table

#: Samples of a row of a stored payload.
WIDTH = 64

ITEM = "array<struct<position: int, kind: string, text: string, ref: string, caption: string>>"

_REFERS = {"img": "src", "video": "src", "audio": "src", "source": "src", "embed": "src", "object": "data", "iframe": "src"}
_APART = {"p", "div", "br", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "th", "article", "section", "header", "footer", "nav", "aside", "main", "blockquote", "pre", "figure", "figcaption", "title", "body", "head", "html", "form", "dl", "dt", "dd"}
#: Elements whose content isn't shown. The last two hold ordinary elements: where one is never closed, what follows is shown.
_UNSEEN, _MAYBE = {"script", "style", "template", "noscript"}, ("template", "noscript")


def _plain(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


class _Sequence(HTMLParser):
    """Collects text blocks and media references in the order of the page."""

    def __init__(self, unseen: set[str]):
        super().__init__(convert_charrefs=True)
        self.hidden = dict.fromkeys(unseen, 0)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.figures: list[int] = []  # the first item of each open figure
        self.caption: list[str] | None = None
        self.captions: list[tuple[int, str]] = []  # of the open figures: which figure, what

    def shown(self) -> bool:
        return not any(self.hidden.values())

    def add(self, kind: str, text: str | None, ref: str | None = None, caption: str | None = None) -> None:
        self.items.append({"kind": kind, "text": text, "ref": ref, "caption": caption})

    def block(self) -> None:
        if text := _plain(self.text):
            self.add("text", text)
        self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.hidden:
            self.hidden[tag] += 1
        if not self.shown():
            return
        if self.caption is not None and tag in _APART | set(_REFERS):
            self.caption.append(" ")
        if self.caption is None and (tag in _APART or tag in _REFERS):
            self.block()
        if tag == "figure":
            self.end_caption()
            self.figures.append(len(self.items))
        if tag == "figcaption" and self.figures:  # outside a figure it is a block like any other
            self.end_caption()
            self.caption = []
        if tag in _REFERS and (ref := (dict(attrs).get(_REFERS[tag]) or "").strip()):
            self.add("media", None, ref, dict(attrs).get("alt") or None)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in self.hidden:
            self.hidden[tag] -= 1

    def end_caption(self) -> None:
        if self.caption is not None:
            if text := _plain(self.caption):
                self.captions.append((len(self.figures), text))
            self.caption = None

    def end_figure(self) -> None:
        """The figure's media get its caption; without media the caption is text."""
        self.end_caption()
        own = " ".join(text for depth, text in self.captions if depth == len(self.figures))
        self.captions = [x for x in self.captions if x[0] < len(self.figures)]
        media = [x for x in self.items[self.figures.pop() :] if x["kind"] == "media"]
        for item in media if own else []:
            item["caption"] = own
        if own and not media:
            self.add("text", own)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            self.hidden[tag] = max(0, self.hidden[tag] - 1)
        if not self.shown():
            return
        if tag == "figcaption":
            self.end_caption()
        if tag in _APART:
            if self.caption is None:
                self.block()
            else:
                self.caption.append(" ")
        if tag == "figure" and self.figures:
            self.end_caption()
            self.block()
            self.end_figure()

    def handle_data(self, data: str) -> None:
        if self.shown():
            (self.text if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    """The items of a page: position from 0, kind `text` or `media`, text, ref and caption.

    Text is parted at block elements and at media, with runs of white space as one space. The caption of a
    media item is its figure's figcaption, before or after it, or else its alt text; a figcaption without media
    is text. Scripts, styles, closed templates and noscripts, and comments are left out. Null, empty and broken
    HTML give what can be read of it, at worst nothing.
    """
    if not html:
        return []
    unseen = set(_UNSEEN)
    while True:
        page = _Sequence(unseen)
        page.feed(html)
        page.close()
        never = {x for x in _MAYBE if page.hidden.get(x)}
        if not never:
            break
        unseen -= never
    page.end_caption()
    page.block()
    while page.figures:
        page.end_figure()
    return [{"position": i, **item} for i, item in enumerate(page.items)]


def sequences(df: DataFrame, html: str = "html", out: str = "items") -> DataFrame:
    """df with the column `out`: the page's items in order (see parse). Rows and other columns stay; a column of that name is replaced."""
    kept = [c for c in df.columns if c != out]
    source = df.select(*kept)
    schema = source.select("*", F.lit(None).cast(ITEM).alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), *((x, pa.string()) for x in ("kind", "text", "ref", "caption"))]))
        for batch in batches:
            items = pa.array([parse(x) for x in batch.column(html).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, items], [*kept, out])

    return source.mapInArrow(run, schema)


def padded(text: Column) -> Column:
    """The text as UTF-8 (null: empty) with bytes 0 up to a positive multiple of WIDTH."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = F.greatest(F.lit(WIDTH), F.ceil(F.octet_length(raw) / WIDTH) * WIDTH).cast("int")
    return F.rpad(raw, size, F.lit(b"\0"))


def encode(payload: bytes) -> bytes:
    """The payload as a portable greymap of 8-bit samples, WIDTH to a row; its size is a multiple of WIDTH."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("a payload fills whole rows")
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def decode(stored: bytes) -> bytes:
    """The samples of a greymap that encode() made."""
    magic, size, most, samples = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or most != b"255" or len(samples) != width * height:
        raise ValueError("not a greymap of 8-bit samples")
    return samples


def feature(payload: bytes) -> str:
    """Rows, least, greatest, sum and sum of squares of the samples, and the number in each sixteenth of their range."""
    x = np.frombuffer(payload, np.uint8)
    count = np.bincount(x, minlength=256)
    value = np.arange(256)
    some = np.flatnonzero(count)
    parts = count.reshape(16, 16).sum(axis=1)
    return f"rows={len(x) // WIDTH};min={some[0]};max={some[-1]};sum={count @ value};squares={count @ (value * value)};parts=" + ",".join(map(str, parts))


def store(df: DataFrame, digest: str, payload: str) -> DataFrame:
    """(digest, media): the payloads in stored form, written to the shared folder. Rows without a payload are left out.

    A task stores a payload once, however often it comes; two tasks may both store it, and it resolves once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there: set[str] = set()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                names, media = [], []
                for name, x in zip(*(batch.slice(i, 256).column(c).to_pylist() for c in ("digest", "payload")), strict=True):
                    if name not in there:
                        there.add(name)
                        names.append(name)
                        media.append(encode(x))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(media, pa.binary())], ["digest", "media"])

    rows = df.select(F.col(digest).alias("digest"), F.col(payload).alias("payload")).where("payload IS NOT NULL")
    return shared_table(rows.mapInArrow(run, "digest string, media binary"), "media")


def describe(stored: DataFrame) -> DataFrame:
    """(digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), one row for each
    digest: what the stored bytes, read again, hold. The tail is the last 64 bytes of the payload."""
    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            made: list[list] = [[] for _ in names[1:]]
            for i in range(batch.num_rows):
                media = batch.column("media")[i].as_py()
                payload = decode(media)
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload))
                for x, y in zip(made, row, strict=True):
                    x.append(y)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *(pa.array(x, k) for x, k in zip(made, kinds, strict=True))], names)

    found = stored.select("digest", "media").mapInArrow(run, schema)
    return found.groupBy("digest").agg(*(F.first(c).alias(c) for c in found.columns[1:]))


def shown(df: DataFrame, items: str = "items", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each media item of df's sequences: the columns `keep`, its position, ref, caption and the digest that
    the ref names as `sha256:...` (null if it names none); a column of `keep` with one of these names gives way."""
    names = kept(keep, "position", "ref", "caption", "digest")
    rows = df.select(*names, F.explode(items).alias("_item")).where("_item.kind = 'media'")
    digest = F.nullif(F.regexp_extract("_item.ref", r"^sha256:([0-9a-f]{64})$", 1), F.lit(""))
    return rows.select(*names, "_item.position", "_item.ref", "_item.caption", digest.alias("digest"))


def resolve(found: DataFrame, media: DataFrame) -> DataFrame:
    """found (see shown), with what `media` (one row for each digest) says of each item's digest; nulls if nothing.

    Positions and captions come from the page and stay as they are. Payloads themselves don't move, and digests that
    many items show meet their facts by broadcast (see join_hot). Both tables are settled first.
    """
    return join_hot(cut(found), cut(media), "digest", "left")


def archive(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's text as a payload of a page that shows it: stored, read back and resolved by its digest.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, position,
    caption). Null is as empty, which is 64 bytes 0; equal texts have equal values; repeated rows, and rows with
    a null doc_id, come out as they come in. A very long text is one payload; an empty table gives an empty one.
    Other columns aren't looked at.
    """
    payload = padded(F.col(text))
    rows = df.select(F.col(doc_id).alias("doc_id"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), F.sha2(payload, 256).alias("digest"), payload.alias("payload"))
    stored = store(rows, "digest", "payload")
    page = F.concat(F.lit('<figure><img src="sha256:'), F.col("digest"), F.lit('" alt="text"><figcaption>document '), F.coalesce(F.col("doc_id").cast("string"), F.lit("without id")), F.lit("</figcaption></figure>"))
    pages = sequences(rows.select("doc_id", "n_bytes", page.alias("html")))
    found = resolve(shown(pages, keep=("doc_id", "n_bytes")), describe(stored))
    done(stored)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def illustrated(pages: DataFrame, page_id: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(page_id, items, media, positions, captions, text_sha256, payload_bytes) for every page, with a figure in the place
    of each `<br>`: how many items it has and how many of them are media, where these are and what their captions
    say, a digest of its text items, and the bytes of the payloads that its media resolve to.

    The figure's payload is the page's URL (see padded). A null page has no items.
    """
    payload = padded(F.col(url))
    figure = F.concat(F.lit('<figure><img src="sha256:'), F.sha2(payload, 256), F.lit('"><figcaption>page '), F.coalesce(F.col(page_id).cast("string"), F.lit("?")), F.lit("</figcaption></figure>"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.replace(F.col(html), F.lit("<br>"), figure).alias("html"), F.sha2(payload, 256).alias("digest"), payload.alias("payload"), F.xxhash64(page_id, url, html).alias("row"))
    read = cut(sequences(rows.select("row", "page_id", "html")).drop("html"))
    stored = store(rows, "digest", "payload")
    found = resolve(shown(read, keep=("row",)), describe(stored))
    done(stored)
    of = found.groupBy("row", "position").agg(F.first("caption").alias("caption"), F.first("payload_bytes").alias("bytes"))
    of = of.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("position", "caption"))).alias("m"), F.sum("bytes").alias("payload_bytes"))
    join = lambda f: F.coalesce(F.array_join(F.transform("m", f), "|"), F.lit(""))
    text = F.array_join(F.transform(F.filter("items", lambda i: i["kind"] == "text"), lambda i: i["text"]), "\n")
    out = read.join(of, "row", "left")
    return out.select(
        "page_id", F.size("items").alias("items"), F.coalesce(F.size("m"), F.lit(0)).alias("media"), join(lambda x: x["position"].cast("string")).alias("positions"),
        join(lambda x: x["caption"]).alias("captions"), F.sha2(text, 256).alias("text_sha256"), F.coalesce("payload_bytes", F.lit(0)).alias("payload_bytes"),
    )
