"""Ways a feed of posts comes in."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline import params as P
from hearthline.functions.text import any_contains, strip

_ANCHOR = r"(?is)<a\b[^>]*>.*?</a>"
_HREF = r"""(?is)^<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""
_TAG = r"(?s)<[^>]*>"
_ROLE = r"""(?is)^<a\b[^>]*?\brole\s*=\s*["']{role}["']"""
# The named character references that occur in labels; numeric ones are decoded by rule.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One post per text file: (file, text)."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\z", 1).alias("file"), F.col("value").alias("text")
    )


def write_text_files(posts: DataFrame, folder: str, key: Column, text: Column, folders: int = 256) -> int:
    """Each key's texts as the lines of a file of its own; the number of files.  ``read_text_files`` takes ``folder/*/``.

    Tasks write straight into ``folders`` folders, by the key's hash: a folder, a checksum and two renames for each
    file, as Spark's writer makes them for a partition, cost more than small texts do.  A repeated task writes the same
    files again.  A null text is an empty line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        made, last, out, n = set(), None, None, 0
        for batch in batches:
            for place, name, value in zip(*(batch.column(c).to_pylist() for c in ("place", "key", "text")), strict=True):
                if out is None or (place, name) != last:
                    if out is not None:
                        out.close()
                    if place not in made:
                        files.create_dir(f"{root}/{place:04d}", recursive=True)
                        made.add(place)
                    file = "null%" if name is None else quote(name, safe="")  # no key is quoted so
                    out, last, n = files.open_output_stream(f"{root}/{place:04d}/{file}.txt"), (place, name), n + 1
                out.write((value or b"") + b"\n")
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = posts.select(F.pmod(F.xxhash64(key), F.lit(folders)).cast("int").alias("place"), key.cast("string").alias("key"), text.cast("binary").alias("text"))
    rows = rows.repartition("place", "key").sortWithinPartitions("place", "key")
    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def canonical_url(href: Column, base_url: str) -> Column:
    """A link without its query, made absolute."""
    bare = F.split_part(href, F.lit("?"), F.lit(1))
    return F.when(F.startswith(bare, F.lit("/")), F.concat(F.lit(base_url.rstrip("/")), bare)).otherwise(bare)


def unescape(col: Column) -> Column:
    """A label's text without character references."""
    for name, plain in _ENTITIES:
        col = F.replace(col, F.lit(name), F.lit(plain))
    return col


def post_link(
    html: Column,
    base_url: str,
    segments=P.POST_LINK_SEGMENTS,
    skip: str = P.COMMENT_LINK_TOKEN,
    role: str | None = "link",
) -> Column:
    """struct(url, date_text) of the first link to a post in a piece of markup; NULL if there is none.

    Only anchors of the given ``role`` count, or all with None.
    """
    anchors = F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(0))
    if role is not None:
        anchors = F.filter(anchors, lambda a: F.rlike(a, F.lit(_ROLE.format(role=role))))
    links = F.transform(
        anchors,
        lambda a: F.struct(
            unescape(F.regexp_extract(a, _HREF, 1)).alias("href"), strip(unescape(F.regexp_replace(a, _TAG, ""))).alias("label")
        ),
    )
    wanted = F.filter(links, lambda a: any_contains(a["href"], segments) & ~F.contains(a["href"], F.lit(skip)))
    first = F.get(wanted, F.lit(0))
    return F.when(
        first.isNotNull(),
        F.struct(canonical_url(first["href"], base_url).alias("url"), first["label"].alias("date_text")),
    )


def page_links(
    pages: DataFrame, base_url: str, segments=P.POST_LINK_SEGMENTS, html: str = "html", role: str | None = "link"
) -> DataFrame:
    """Add ``url`` and ``post_date_text`` of each page's post link."""
    return (
        pages.withColumn("_link", post_link(F.col(html), base_url, segments, role=role))
        .withColumns({"url": F.col("_link.url"), "post_date_text": F.col("_link.date_text")})
        .drop("_link")
    )
