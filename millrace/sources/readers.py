"""Readers of JSON lines, archives and pages. Archives are read by Spark as binary files, so any store will do."""

from __future__ import annotations

import hashlib
import html.parser
import io
import json
import signal
import tarfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How often a damaged line is tried again without its last character.
REPAIR_TRIES = 20


def spread(rows: DataFrame) -> DataFrame:
    """Rows of fewer files than there are cores, dealt to all cores: a small file is one task's work otherwise.

    Tables of many files stay as they are, without a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Lines as rows; a damaged line fails the read if strict, and is a null row otherwise."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def repair_json(lines: DataFrame, column: str = "value", tries: int = REPAIR_TRIES) -> DataFrame:
    """Lines of more than two characters with ``json`` (null: beyond repair) and ``lost``, the characters cut from the end.

    Spark's own parsers pass over what follows a complete value, so lines are checked in Arrow batches.
    """
    rows = lines.where(F.length(F.trim(column)) > 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_repair(x, tries) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in out], pa.string()), pa.array([n for _, n in out], pa.int32())], [*batch.schema.names, "json", "lost"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, json string, lost int")


def _repair(line: str, tries: int) -> tuple[str | None, int]:
    for lost in range(min(tries, len(line))):
        text = line[: len(line) - lost]
        try:
            json.loads(text)
        except ValueError:
            continue
        return text, lost
    return None, 0


def zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of the members of zip files."""
    return _members(spark, path, lambda data: ((n, z.read(n)) for z in [zipfile.ZipFile(io.BytesIO(data))] for n in z.namelist())).select("path", F.posexplode(F.split(F.col("data").cast("string"), "\n")).alias("line", "value")).where("value <> ''")


def tar_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, name, data) of the files in tar archives; damaged archives give none."""

    def members(data: bytes) -> Iterator[tuple[str, bytes]]:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if m.isfile():
                    yield m.name, t.extractfile(m).read()

    return _members(spark, path, members)


def _members(spark: SparkSession, path: str, opener) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    found = list(opener(data))
                except (tarfile.TarError, zipfile.BadZipFile, OSError):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([where] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array([n for n, _ in found], pa.string()), pa.array([d for _, d in found], pa.binary())], ["path", "pos", "name", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, pos int, name string, data binary")


def group_by_key(members: DataFrame) -> DataFrame:
    """Consecutive members with one stem are a sample: (path, sample, key, parts by lower-case suffix).

    A sample ends where the stem changes or a suffix comes again. Members without a suffix are skipped.
    """
    stem, suffix = F.regexp_extract("name", r"^((?:.*/)?[^/.]+)\.(.+)$", 1), F.lower(F.regexp_extract("name", r"^(?:.*/)?[^/.]+\.(.+)$", 1))
    rows = members.withColumn("key", stem).withColumn("suffix", suffix).where("suffix <> ''")
    order = Window.partitionBy("path").orderBy("pos")
    run = rows.withColumn("_new", F.coalesce((F.lag("key").over(order) != F.col("key")).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(order))
    again = run.withColumn("_again", F.row_number().over(Window.partitionBy("path", "_run", "suffix").orderBy("pos")))
    grouped = again.groupBy("path", "_run", "_again", "key").agg(F.map_from_entries(F.collect_list(F.struct("suffix", "data"))).alias("parts"), F.min("pos").alias("_at"))
    return grouped.select("path", F.row_number().over(Window.partitionBy("path").orderBy("_at")).alias("sample"), "key", "parts")


class _Body(html.parser.HTMLParser):
    """Blocks of a page with their link text, without scripts, styles, navigation and footers."""

    SKIPPED = ("script", "style", "nav", "footer", "aside", "header", "form", "noscript", "title")
    BLOCKS = ("p", "div", "article", "section", "li", "ul", "ol", "td", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "br", "main", "body")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip = self.link = 0
        self.blocks: list[list] = [["", 0]]

    def handle_starttag(self, tag: str, attrs) -> None:
        self.skip += tag in self.SKIPPED
        self.link += tag == "a"
        if tag in self.BLOCKS:
            self.blocks.append(["", 0])

    def handle_endtag(self, tag: str) -> None:
        self.skip = max(0, self.skip - (tag in self.SKIPPED))
        self.link = max(0, self.link - (tag == "a"))
        if tag in self.BLOCKS:
            self.blocks.append(["", 0])

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.blocks[-1][0] += data
            self.blocks[-1][1] += len(data.strip()) if self.link else 0


def main_body(text: str | None, least: int = 20, most_links: float = 0.5) -> str:
    """The page's blocks of enough text that isn't mostly links."""
    parser = _Body()
    parser.feed(text or "")
    parser.close()
    return body_of(parser, least, most_links)


def body_of(parser: _Body, least: int = 20, most_links: float = 0.5) -> str:
    blocks = ((" ".join(t.split()), n) for t, n in parser.blocks)
    return "\n".join(t for t, n in blocks if len(t) >= least and n <= most_links * len(t))


def extract_pages(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``body`` in place of the html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [n for n in batch.schema.names if n != column]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array([main_body(x) for x in batch.column(column).to_pylist()], pa.string())], [*keep, "body"])

    schema = ", ".join(f"`{n}` {t}" for n, t in pages.dtypes if n != column)
    return pages.mapInArrow(run, f"{schema}, body string")


#: Media elements and the attribute that names their file.
MEDIA = {"img": "src", "video": "src", "audio": "src", "source": "src", "iframe": "src"}


class _Document(_Body):
    """A page's title and media beside its blocks."""

    def __init__(self) -> None:
        super().__init__()
        self.title, self.in_title, self.media = "", False, []

    def handle_starttag(self, tag: str, attrs) -> None:
        super().handle_starttag(tag, attrs)
        self.in_title = self.in_title or tag == "title"
        name = dict(attrs).get(MEDIA.get(tag, ""))
        if name and not self.skip:
            self.media.append(name)

    def handle_endtag(self, tag: str) -> None:
        super().handle_endtag(tag)
        self.in_title = self.in_title and tag != "title"

    def handle_data(self, data: str) -> None:
        super().handle_data(data)
        self.title += data if self.in_title else ""


class _Late(Exception):
    """Raised by the alarm of ``within``."""


@contextmanager
def within(seconds: float) -> Iterator[None]:
    """Stop the body after so many seconds. Alarms reach the main thread only; elsewhere the body runs without a limit."""

    def late(_signal, _frame) -> None:
        raise _Late

    try:
        before = signal.signal(signal.SIGALRM, late)
    except (ValueError, AttributeError):
        yield
        return
    try:
        signal.setitimer(signal.ITIMER_REAL, seconds)
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def page_document(page: str | None, record: str | None, base: str | None = None, seconds: float = 30.0, **options) -> dict | None:
    """A page as (id, title, text, media, fingerprint); None without a page, without text or after ``seconds``.

    Media are absolute against ``base``. The fingerprint is a digest of title and text with a space between them.
    """
    if not page:
        return None
    try:
        with within(seconds):
            parser = _Document()
            parser.feed(page)
            parser.close()
            text, title = body_of(parser, **options), " ".join(parser.title.split())
            media = [urljoin(base or "", m) for m in dict.fromkeys(parser.media)]
    except _Late:
        return None
    if not text and not media:
        return None
    return {"id": record, "title": title, "text": text, "media": media, "fingerprint": hashlib.sha256(f"{title} {text}".encode(errors="replace")).hexdigest()}


#: Settings of ``main_body`` by type of page: posts of a forum are shorter, and are full of links to their writers.
PAGE_TYPES = {"article": {}, "forum": {"least": 5, "most_links": 0.8}, "weixin": {"least": 1}}


def page_documents(pages: DataFrame, key: str, column: str = "html", url: str = "url", kind: str = "article", seconds: float = 30.0) -> DataFrame:
    """(key, document) of each page, null where it took too long or held nothing. A page that fails costs its own row only."""
    options = PAGE_TYPES[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = pa.struct([("id", pa.string()), ("title", pa.string()), ("text", pa.string()), ("media", pa.list_(pa.string())), ("fingerprint", pa.string())])
        for batch in batches:
            keys, found, urls = (batch.column(n).to_pylist() for n in ("key", "page", "url"))
            done = [page_document(p, None if k is None else str(k), u, seconds, **options) for k, p, u in zip(keys, found, urls, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(done, form)], ["key", "document"])

    kinds = dict(pages.dtypes)
    rows = pages.select(F.col(key).alias("key"), F.col(column).alias("page"), F.col(url).alias("url"))
    made = rows.mapInArrow(run, f"key {kinds[key]}, document struct<id string, title string, text string, media array<string>, fingerprint string>")
    return made.withColumnRenamed("key", key)


def text_with_retry(spark: SparkSession, path: str, tries: int = 10, pause: float = 1.0) -> DataFrame:
    """Lines of more than two characters with their file, listing the files again if the store fails meanwhile.

    Reading itself is retried by Spark's tasks (``spark.task.maxFailures``).
    """
    import time

    for n in range(tries):
        try:
            return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("url")).where(F.length(F.trim("value")) > 2)
        except Exception:
            if n + 1 == tries:
                raise
            time.sleep(pause)
    raise ValueError("tries must be positive")


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file that is one JSON document, or a list of records."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def json_by_suffix(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """``.json`` as one document, ``.jsonl`` as lines; other names are an error."""
    if path.endswith(".jsonl"):
        return json_lines(spark, path, schema, strict=True) if schema else spark.read.option("mode", "FAILFAST").json(path)
    if path.endswith(".json"):
        return json_document(spark, path, schema)
    raise ValueError(f"neither .json nor .jsonl: {path}")


def samples_of_lines(spark: SparkSession, path: str) -> DataFrame:
    """(url, json): a sample for each line of JSON lines, or of those in zip files."""
    if path.endswith(".zip"):
        return zipped_lines(spark, path).select(F.col("path").alias("url"), F.col("value").alias("json"))
    return spark.read.text(path).where("value <> ''").select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("json"))


def shards(spark: SparkSession, top: str, folders: str = "*", names: str = "*.jsonl") -> DataFrame:
    """(url, length): the files below the folders that match, found by the store's listing without reading them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", names).load(f"{top.rstrip('/')}/{folders}")
    return found.select(F.col("path").alias("url"), "length")


def expand_braces(pattern: str) -> list[str]:
    """``a{0..2}{x,y}`` as all names it stands for; numbers keep the width of the first."""
    import re

    m = re.search(r"\{([^{}]*)\}", pattern)
    if m is None:
        return [pattern]
    span = re.fullmatch(r"(\d+)\.\.(\d+)", m[1])
    if span:
        low, high = int(span[1]), int(span[2])
        inside = [str(i).zfill(len(span[1])) for i in range(low, high + 1)]
    else:
        inside = m[1].split(",")
    return [x for part in inside for x in expand_braces(pattern[: m.start()] + part + pattern[m.end() :])]


def dataset_size(spark: SparkSession, pattern: str, sizes: DataFrame | None, total: int | None = None) -> tuple[int | None, int]:
    """Samples and shards of a pattern: from (name, size) rows, shards without one counting 0, or else the given total."""
    names = [x.rpartition("/")[2] for x in expand_braces(pattern)]
    if sizes is None:
        return total, len(names)
    listed = spark.createDataFrame([(x,) for x in names], "name string")
    found = listed.join(sizes, "name", "left").agg(F.sum(F.coalesce("size", F.lit(0))).alias("n")).first()
    return int(found.n or 0), len(names)


def headerless_csv(spark: SparkSession, path: str, columns: list[str], first: int | None = None) -> DataFrame:
    """Rows of CSV files without headers, with ``url``; the first rows of each file if asked for.

    Such a file is a subject's examples. A file is read as one partition's rows in order, since quoted fields may hold line
    feeds.
    """
    rows = spark.read.option("multiLine", True).option("escape", '"').schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("url"), F.monotonically_increasing_id().alias("_n"))
    if first is None:
        return rows.drop("_n")
    place = F.row_number().over(Window.partitionBy("url").orderBy("_n"))
    return rows.withColumn("_k", place).where(F.col("_k") <= first).drop("_k", "_n")


def tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).csv(path)


def keyed_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Records of JSON lines, one a key: the last of those with the same key."""
    rows = json_lines(spark, path, schema).where(F.col(key).isNotNull())
    rows = rows.withColumn("_at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    names = [c for c in rows.columns if c not in (key, "_at")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*names), "_at").alias("r"))
    return last.select(key, "r.*")


def decoded_images(rows: DataFrame, column: str = "image") -> DataFrame:
    """Base64 text as bytes; null where it is none."""
    return rows.withColumn(column, F.expr(f"try_to_binary(`{column}`, 'base64')"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(name, data): whole files by their last path segment, for joins on names."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("data"))


def context_images(spark: SparkSession, path: str) -> DataFrame:
    """(name, data) of a folder of files, or of a JSON map from names to base64 text."""
    if not path.endswith(".json"):
        return files(spark, path)
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "data"))
    return decoded_images(whole, "data")


def read_shards(spark: SparkSession, path: str, rows_each: int) -> DataFrame:
    """(url, shard, row, index, json): lines of shards in order of their names, with their places in the shard and overall.

    A shard is read by one task, in order; shards hold ``rows_each`` lines at most, so that places are known without a count.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), "value")
    named = whole.select("url", F.regexp_extract(F.element_at(F.split("url", "/"), -1), r"([0-9]+)[^0-9]*$", 1).cast("long").alias("shard"), F.posexplode(F.split("value", "\n")).alias("row", "json"))
    return named.where("json <> ''").select("url", "shard", F.col("row").cast("long").alias("row"), (F.col("shard") * rows_each + F.col("row")).alias("index"), "json")
