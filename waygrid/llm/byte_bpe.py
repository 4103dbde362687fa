"""Byte-level BPE: ids by a local rank file, and back to raw bytes.

Texts over `part_chars` are cut before the pattern sees them, at places where every match
of the pattern ends anyway: before a space that follows a character which is no white
space. No alternative of the pattern matches other text followed by white space, and only
runs of white space look ahead, so the ids are those of the whole text.

Null and empty texts give no ids. Equal rows are encoded each. The input's other columns
are left out, so names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygrid.llm.common import strings

CUT = re.compile(r"(?<=\S) ")


class ByteBpe:
    def __init__(self, rank_file: str, pattern: str, part_chars: int = 1 << 16):
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.part_chars = part_chars
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def parts(self, text: str):
        at = 0
        while len(text) - at > self.part_chars:
            m = CUT.search(text, at + self.part_chars)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit integers."""
        found = [self.library.encode_to_numpy(p, disallowed_special=()) for p in self.parts(text)]
        return (found[0] if len(found) == 1 else np.concatenate(found)).astype("<u4", copy=False)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def _coder(rank_file: str, pattern: str) -> ByteBpe:
    return ByteBpe(rank_file, pattern)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, ids (binary,
    little-endian uint32). One narrow pass over whole texts, no shuffle."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def run(batches):
        coder = _coder(rank_file, pattern)
        for b in batches:
            n, ids_hash, back, kept = [], [], [], []
            for text in strings(b.column("text")):
                ids = coder.encode(text)
                raw = ids.tobytes()
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(raw).hexdigest())
                back.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(raw)
            columns = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_ids, [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, raw (the bytes that the ids stand for) from doc_id, ids; null ids give no bytes."""

    def run(batches):
        coder = _coder(rank_file, pattern)
        for b in batches:
            raw = [coder.decode(np.frombuffer(x or b"", "<u4")) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, raw binary")
