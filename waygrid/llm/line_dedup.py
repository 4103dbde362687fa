"""Line dedup: hashes in ranges, sorted by document and position, first occurrences kept.

A line's key is the line without ASCII white space at its ends, A-Z in lower case. A key of
at least `min_chars` code points that at least `min_docs` documents hold loses its lines in
all documents but that with the largest doc_id.

Texts stay where they are: 128-bit hashes of keys travel, one row for each key of a
document with its line numbers. They are partitioned by ranges of (hash, doc_id), so that
a line which a third of all documents hold is spread over many tasks, and sorted, largest
doc_id first. Each task streams its rows: the first document of a hash keeps its lines.
Only the first and the last hash of a partition may go on in a neighbour; for those, a
summary of each partition (two rows, so 2 x partitions rows in all) is joined. What comes
back is a compressed bitmap of kept lines for each document that loses some.

Null or empty text is one empty line. Null doc_id counts as a document below all others.
Rows with equal doc_id count as one document; each of them is cleaned by its own text.
Lines shorter than min_chars always stay. `dedup_lines` carries every other column through;
helper columns have names of their own.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygrid.llm.common import ASCII_SPACE, dropped, saved, shuffles_end_with_steps

LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
UPPER = re.compile("[A-Z]")
LEAST = -(1 << 63)
#: Helper columns of a document: its id with null as the least number, and a hash of its text.
DOC, TEXT = "__line_doc", "__line_text"


def line_key(line: str) -> str:
    line = line.strip(ASCII_SPACE)
    return line.translate(LOWER) if UPPER.search(line) else line


def _identified(docs: DataFrame) -> DataFrame:
    return docs.withColumn(DOC, F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))).withColumn(TEXT, F.xxhash64("text"))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, doc, text, n_lines, lines: one row for each key of a document."""

    def run(batches):
        for b in batches:
            h1, h2, at, n_lines, lines = [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                if not text or len(text) < min_chars:
                    continue
                rows = text.split("\n")
                found: dict[str, list[int]] = {}
                for j, line in enumerate(rows):
                    if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
                        found.setdefault(key, []).append(j)
                for key, where in found.items():
                    x = xxhash.xxh3_128_intdigest(key.encode())
                    h1.append((x >> 64) - (1 << 63))
                    h2.append((x & ((1 << 64) - 1)) - (1 << 63))
                    lines.append(where)
                at += [i] * len(found)
                n_lines += [len(rows)] * len(found)
            pick = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), b.column(DOC).take(pick), b.column(TEXT).take(pick), pa.array(n_lines, pa.int32()), pa.array(lines, pa.list_(pa.int32()))],
                ["h1", "h2", "doc", "text", "n_lines", "lines"],
            )

    return _identified(docs).select(DOC, TEXT, "text").mapInArrow(run, "h1 long, h2 long, doc long, text long, n_lines int, lines array<int>")


DROP, OPEN, SUMMARY = 0, 1, 2
#: Hashes at the edges of partitions (24 bytes each) up to which their summary is broadcast.
MOST_EDGES = 100_000


def _stream(min_docs: int):
    """Streams one sorted partition. Yields rows to drop, rows that a neighbour decides, and
    a summary of the partition's first and last hash. Holds the rows of a hash only until
    min_docs documents were seen."""

    def run(batches):
        schema = pa.schema([("kind", pa.int8()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("text", pa.int64()), ("n_lines", pa.int32()), ("lines", pa.list_(pa.int32())), ("n_docs", pa.int64())])
        key = first_key = None
        n_docs = most = last_doc = 0
        held: list[tuple] = []  # rows of the current hash below its first document, not decided yet
        out: list[tuple] = []

        def flush():
            columns = list(zip(*out)) or [()] * 8
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        def close(last: bool):
            if key is not None and (last or key == first_key):
                out.append((SUMMARY, *key, most, 0, 0, [], n_docs))
            if last:
                out.extend((OPEN, *key, *row, 0) for row in held)
            held.clear()

        for b in batches:
            for h1, h2, doc, text, n_lines, lines in zip(*[b.column(c).to_pylist() for c in ("h1", "h2", "doc", "text", "n_lines", "lines")]):
                if key != (h1, h2):
                    close(False)
                    key = (h1, h2)
                    first_key = first_key or key
                    n_docs, most, last_doc = 1, doc, doc
                elif doc != last_doc:
                    n_docs, last_doc = n_docs + 1, doc
                if key == first_key:
                    out.append((OPEN, h1, h2, doc, text, n_lines, lines, 0))
                    continue
                if n_docs >= min_docs and held:
                    out.extend((DROP, h1, h2, *row, 0) for row in held)
                    held.clear()
                if doc != most:
                    row = (doc, text, n_lines, lines)
                    if n_docs >= min_docs:
                        out.append((DROP, h1, h2, *row, 0))
                    else:
                        held.append(row)
            if len(out) > 4096:
                yield flush()
        if key is not None:
            close(True)
        yield flush()

    return run, "kind byte, h1 long, h2 long, doc long, text long, n_lines int, lines array<int>, n_docs long"


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """__line_doc, __line_text, bitmap of the documents that lose lines: zlib of one bit for
    each line, 1 for those that stay."""
    rows = saved(line_hashes(docs, min_chars), "line-hashes")  # ranges are sampled from them
    ranged = rows.repartitionByRange(F.col("h1"), F.col("h2"), F.col("doc").desc()).sortWithinPartitions("h1", "h2", F.col("doc").desc(), "text")
    with shuffles_end_with_steps(docs.sparkSession):
        seen = saved(ranged.mapInArrow(*_stream(min_docs)), "line-runs")
    dropped(rows)
    edges = seen.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.sum("n_docs").alias("docs"), F.max("doc").alias("most")).where(F.col("docs") >= min_docs)
    edges = saved(edges, "line-edges")
    few = edges.limit(MOST_EDGES + 1).count() <= MOST_EDGES
    decided = seen.where(F.col("kind") == OPEN).join(F.broadcast(edges) if few else edges, ["h1", "h2"]).where(F.col("doc") < F.col("most"))  # at most two rows a partition
    columns = ["doc", "text", "n_lines", "lines"]
    gone = seen.where(F.col("kind") == DROP).select(columns).unionByName(decided.select(columns))
    per_doc = gone.groupBy("doc", "text").agg(F.max("n_lines").alias("n_lines"), F.flatten(F.collect_list("lines")).alias("lines"))

    def pack(batches):
        for b in batches:
            maps = []
            for n, lines in zip(b.column("n_lines").to_pylist(), b.column("lines").to_pylist()):
                keep = np.ones(n, np.uint8)
                keep[lines] = 0
                maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("text"), pa.array(maps, pa.binary())], [DOC, TEXT, "__line_keep"])

    return per_doc.mapInArrow(pack, f"{DOC} long, {TEXT} long, __line_keep binary")


def kept_lines(text: str | None, bitmap: bytes | None) -> tuple[list[str], int]:
    """The lines that stay, and how many there were."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return lines, len(lines)
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
    return [lines[i] for i in np.flatnonzero(keep)], len(lines)


def _marked(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    return _identified(docs).join(keep_bitmaps(docs, min_chars, min_docs), [DOC, TEXT], "left")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with the lines that stay as text (and n_chars, if there is one, as its length)."""
    names = docs.columns

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            maps = b.column("__line_keep").to_pylist()
            # a null text without a bitmap stays null
            texts = [t if m is None else "\n".join(kept_lines(t, m)[0]) for t, m in zip(b.column("text").to_pylist(), maps)]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type)).select(names)

    out = _marked(docs, min_chars, min_docs).select(*[F.col(f"`{c}`") for c in names], "__line_keep").mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in names]) if "n_chars" in names else out


def dedup_digest(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""

    def run(batches):
        for b in batches:
            found = [kept_lines(t, m) for t, m in zip(b.column("text").to_pylist(), b.column("__line_keep").to_pylist())]
            hashes = [hashlib.sha256("\n".join(kept).encode()).hexdigest() for kept, _ in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for _, n in found], pa.int64()), pa.array([n - len(kept) for kept, n in found], pa.int64()), pa.array(hashes, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _marked(slim, min_chars, min_docs).select("doc_id", "text", "__line_keep").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
