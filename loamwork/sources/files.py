"""Files in and out: markdown folders, JSON lines, mailboxes, train/eval sets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import email as mail_columns


def markdown_folder(spark: SparkSession, path: str) -> DataFrame:
    """All .md and .mdx files below a folder: (file, text), file relative to it (SRC-01, 02)."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,mdx}").text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    root = path.rstrip("/").split("://")[-1]
    return rows.select(F.regexp_replace(F.split(name, "/" + root.rsplit("/", 1)[-1] + "/", 2)[1], "%20", " ").alias("file"), F.col("value").alias("text"))


def strict_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; a bad line fails the read (SRC-05)."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def lenient_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """All *.jsonl of a folder but those that start with _; bad lines vanish (SRC-06)."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("pathGlobFilter", "[!_]*.jsonl").json(path)


def json_mail(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON array or JSON lines of mails, by thread or else by id (SRC-07)."""
    lines = path.rstrip("/").endswith("jsonl")
    rows = spark.read.schema(schema).option("multiLine", not lines).json(path)
    return rows.withColumn("thread", F.coalesce("thread_id", "id"))


_PEOPLE = "array<struct<name:string,email:string>>"
_PARSED = f"file string, start bigint, n bigint, id string, refs array<string>, reply_to string, date string, subject string, sender string, `from` {_PEOPLE}, `to` {_PEOPLE}, cc {_PEOPLE}, text string"


def _decoded(value: str | None) -> str:
    """A header with its encoded words decoded, as it is if they cannot be (EML-01)."""
    from email.header import decode_header, make_header

    try:
        return str(make_header(decode_header(value or ""))).strip()
    except (ValueError, LookupError):
        return (value or "").strip()


def _addresses(value: str | None) -> list[dict[str, str]]:
    """Names and addresses of a header, each pair once, in order (EML-01)."""
    from email.utils import getaddresses

    found = [(_decoded(name), address.strip()) for name, address in getaddresses([value or ""])]
    return [{"name": n, "email": e} for n, e in dict.fromkeys(found) if n or e]


def _message_ids(value: str | None) -> list[str]:
    """What stands in angle brackets in a header; without any the whole of it (EML-01)."""
    import re

    text = _decoded(value)
    return [i.strip() for i in re.findall(r"<([^>]+)>", text)] or ([text.strip("<> ")] if text.strip("<> ") else [])


def _payload(message) -> str:
    """The plain parts of a mail, else its HTML parts; attachments are left out."""
    by: dict[str, list[str]] = {"text/plain": [], "text/html": []}
    for part in message.walk():
        kind = part.get_content_type()
        if part.is_multipart() or kind not in by or (part.get("Content-Disposition") or "").lower().startswith("attachment"):
            continue
        data = part.get_payload(decode=True) or b""
        try:
            by[kind].append(data.decode(part.get_content_charset() or "utf-8", "replace"))
        except LookupError:  # an unknown charset
            by[kind].append(data.decode("utf-8", "replace"))
    return "\n\n".join(by["text/plain"] or by["text/html"])


def mbox_folder(spark: SparkSession, path: str) -> DataFrame:
    """All mails of the .mbox files below a folder (SRC-03, EML-01): file, idx, id, thread_id, date, subject, sender, from, to, cc, body, reply_to.

    Files are split where a line starts with "From ", so a mailbox of any size
    is read by many tasks; idx is a mail's place in its file.  Python reads the
    MIME structure; bodies are cleaned and threads named by the same columns as
    elsewhere.  A date that cannot be read is empty, a missing id is the file
    and place.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import email
        import email.policy
        from email.utils import parsedate_to_datetime

        def iso(value: str | None) -> str:
            try:
                return parsedate_to_datetime(value).isoformat() if value else ""
            except (TypeError, ValueError):
                return ""

        names = [c.split()[0].strip("`") for c in _PARSED.split(", ")]
        for batch in batches:
            rows = []
            for file, start, n, content in zip(batch["file"], batch["start"], batch["n"], batch["content"], strict=True):
                m = email.message_from_bytes(bytes(content).split(b"\n", 1)[-1], policy=email.policy.compat32)
                head = lambda k: m.get(k)  # noqa: B023, E731
                ids, reply = _message_ids(head("Message-ID")), _message_ids(head("In-Reply-To"))
                rows.append((
                    file, start, n, (ids or [None])[0], _message_ids(head("References")), (reply or [None])[0], iso(head("Date")), _decoded(head("Subject")), _decoded(head("From")),
                    _addresses(head("From")), _addresses(head("To")), _addresses(head("Cc")), _payload(m),
                ))
            yield pd.DataFrame(rows, columns=names)

    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.mbox").option("lineSep", "\nFrom ").text(path)
    raw = raw.where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("content"))
    mails = raw.mapInPandas(parse, _PARSED)
    idx = (F.row_number().over(Window.partitionBy("file").orderBy("start", "n")) - 1).alias("idx")
    mails = mails.select("*", idx).withColumn("id", F.coalesce("id", F.concat("file", F.lit("#"), F.col("idx").cast("string"))))
    thread = mail_columns.thread_id(F.col("refs"), F.col("reply_to"), F.col("subject"), F.col("id"))
    return mails.select("file", "idx", "id", thread.alias("thread_id"), "date", "subject", "sender", "from", "to", "cc", mail_columns.body_text(F.col("text")).alias("body"), "reply_to")


def missing_outputs(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Inputs (name) without an output of that name (SRC-04)."""
    return inputs.join(outputs, "name", "left_anti")


def write_split(rows: DataFrame, path: str) -> dict[str, int]:
    """Write train and eval rows (column part) as JSON lines, and their counts as _stats/metadata.json below (SRC-18)."""
    rows.write.partitionBy("part").mode("overwrite").option("ignoreNullFields", False).json(path)
    written = rows.sparkSession.read.json(path)
    counts = {r["part"]: r["n"] for r in written.groupBy("part").agg(F.count("*").alias("n")).collect()}
    stats = rows.sparkSession.createDataFrame([(counts.get("train", 0), counts.get("eval", 0))], "train bigint, eval bigint")
    stats.coalesce(1).write.mode("overwrite").json(f"{path}/_stats/metadata.json")
    return counts


def write_yaml(rows: DataFrame, path: str) -> None:
    """Write rows as YAML lists, one per part file (SRC-08, 09).

    An entry is its row in JSON, which is YAML in flow style, so no task holds
    more than a line and any YAML reader takes the files.
    """
    rows.select(F.concat(F.lit("- "), F.to_json(F.struct(*rows.columns))).alias("value")).write.mode("overwrite").text(path)


def read_yaml(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of YAML files that hold lists, by the schema's members (SRC-08, 09); a file is read by one task.

    Members that are missing are null; a file that is no list gives no rows.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import yaml

        load = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        for batch in batches:
            for content in batch["content"]:
                found = yaml.load(bytes(content).decode("utf-8"), load)
                lines = [json.dumps(x, default=str) for x in found if isinstance(x, dict)] if isinstance(found, list) else []
                yield pd.DataFrame({"line": pd.Series(lines, dtype=object)})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0").select("content")
    return files.mapInPandas(parse, "line string").select(F.from_json("line", f"struct<{schema}>").alias("r")).select("r.*")


def with_hash(chunks: DataFrame) -> DataFrame:
    """Stored chunks with the hash of their content, made anew (SRC-08)."""
    return chunks.withColumn("hash", F.md5(F.coalesce("content", F.lit(""))))


def content_address(rows: DataFrame) -> DataFrame:
    """A digest of the rows' JSON that does not depend on their order (SRC-19): one row, 8 hex digits.

    Line digests are summed, so no task ever holds all lines.
    """
    line = F.to_json(F.struct(*sorted(rows.columns)))
    digest = F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.substring(F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.coalesce(F.sum(digest), F.lit(0)).cast("string")), 256), 1, 8).alias("digest"))
