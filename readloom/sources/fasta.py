"""FASTA and FASTQ input, read numbering and FASTA output."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom.functions.sequence import header_id, header_metadata, wrap_sequence
from readloom.session import _offset_index


def read_fasta_text(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Uncompressed FASTA with splittable scans: ``file_ord, rec, name, comment, seq``.

    The reader breaks the text at record starts, so one file may feed many
    tasks.  ``rec`` orders the records of a file.
    """
    raw = spark.read.option("lineSep", "\n>").text(paths)
    order = F.array_position(F.array(*[F.lit(p) for p in paths]), F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/"))
    body = F.regexp_replace("value", "^>", "")
    header = F.split(body, "\n", 2).getItem(0)
    rest = F.coalesce(F.try_element_at(F.split(body, "\n", 2), F.lit(2)), F.lit(""))
    return raw.where(F.length(F.trim("value")) > 0).select(
        (order - 1).alias("file_ord"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_mid"),
        header_id(F.rtrim(header)).alias("name"),
        header_metadata(F.rtrim(header)).alias("comment"),
        F.regexp_replace(rest, r"\s", "").alias("seq"),
    )


def number_reads(records: DataFrame) -> DataFrame:
    """Adds ``rid`` in file order, then record order, from 0.

    Records of one file block are consecutive in one task; only the row count of
    each block is needed to place them.
    """
    return _offset_index(records, ["file_ord", "block"], "rid").select("rid", "name", "comment", "seq")


class FastxSource(DataSource):
    """``spark.read.format("fastx")``: FASTA or FASTQ, plain or gzip, a file a task.

    Options: ``paths`` separated by newlines, or ``path``; or ``list``, a file
    whose whitespace-separated tokens are paths.  ``strict`` true makes a
    damaged record an error instead of the end of its file.
    """

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return "file_ord int, rec long, name string, comment string, seq string, qual string"

    def reader(self, schema):
        return FastxReader(self.options)


class FastxReader(DataSourceReader):
    def __init__(self, options):
        self.strict = str(options.get("strict", "false")).lower() == "true"
        if options.get("list"):
            with open(options["list"]) as f:
                self.paths = f.read().split()
        else:
            self.paths = [p for p in options.get("paths", options.get("path", "")).split("\n") if p]

    def partitions(self):
        return [InputPartition((i, p)) for i, p in enumerate(self.paths)]

    def read(self, partition) -> Iterator[tuple]:
        order, path = partition.value
        opener = gzip.open if path.endswith(".gz") else open
        with opener(path, "rt") as lines:
            for rec, (header, seq, qual) in enumerate(fastx_records(lines, self.strict)):
                parts = header.split(None, 1)
                yield order, rec, parts[0] if parts else "", parts[1] if len(parts) > 1 else None, seq, qual


def fastx_records(lines, strict: bool = False) -> Iterator[tuple[str, str, str | None]]:
    """Records of FASTA or FASTQ lines, either spread over several lines.

    A quality text is as long as its sequence; one that is cut short ends the
    input (or raises when ``strict``).
    """
    lines = (line.rstrip("\r\n") for line in lines)
    header = next((line for line in lines if line[:1] in (">", "@")), None)
    while header is not None:
        seq, qual, following = [], None, None
        for line in lines:
            if line[:1] in (">", "@"):
                following = line
                break
            if line[:1] == "+":
                qual = ""
                break
            seq.append(line.replace(" ", ""))
        text = "".join(seq)
        if qual is not None:
            while len(qual) < len(text):
                line = next(lines, None)
                if line is None:
                    break
                qual += line
            if len(qual) != len(text):
                if strict:
                    raise ValueError(f"quality of {header[1:]} does not fit its sequence")
                return
            following = next((line for line in lines if line[:1] in (">", "@")), None)
        yield header[1:], text, qual
        header = following


def read_fastx(spark: SparkSession, paths: list[str] | None = None, list_file: str | None = None) -> DataFrame:
    """Numbered reads ``rid, name, comment, seq`` from any mix of files."""
    spark.dataSource.register(FastxSource)
    reader = spark.read.format("fastx")
    reader = reader.option("list", list_file) if list_file else reader.option("paths", "\n".join(paths or []))
    records = reader.load().withColumn("block", F.lit(0)).withColumn("_mid", F.col("rec"))
    return number_reads(records)


def fasta_records(seqs: DataFrame, name: str = "name", width: int | None = None) -> DataFrame:
    """One text row per record; ``width`` wraps the sequence lines."""
    body = F.col("seq") if width is None else wrap_sequence(F.col("seq"), width)
    return seqs.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), body).alias("value"))


def write_fasta(seqs: DataFrame, path: str, name: str = "name", width: int | None = None) -> None:
    fasta_records(seqs, name, width).write.mode("overwrite").text(path)
