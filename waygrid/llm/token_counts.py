"""Token counts: lengths only, from Arrow batches balanced by bytes.

Long texts are cut at safe boundaries. A boundary is safe if no piece of the vocabulary
can span it, which `PieceCounter` proves from the model file before it uses one:
 - before white space that follows other text, if no piece has its space mark anywhere
   but at its start;
 - before and after a line end, if no piece of several characters holds one.
The units between two boundaries are encoded in batches; counts of short units are kept
in a bounded memo, as words recur.

Null and empty texts have 0 tokens. Equal rows are counted each. Other columns of the
input are left out, so names cannot clash.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygrid.llm.common import by_bytes, strings, utf8_size

SPACE_MARK = "▁"


class PieceCounter:
    """Counts the tokens of a sentencepiece model.

    memo_units and memo_bytes bound the memo (units take about 150 bytes beside their text),
    batch_bytes the text that is handled at once."""

    def __init__(self, model_file: str, memo_units: int = 600_000, batch_bytes: int = 1 << 21, memo_bytes: int = 1 << 26):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.memo_units, self.batch_bytes, self.memo = memo_units, batch_bytes, {}
        self.memo_bytes, self.held = memo_bytes, 0
        spec = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            spec.ParseFromString(f.read())
        pieces = [p.piece for p in spec.pieces if p.type not in (2, 3, 5, 6)]
        norm = spec.normalizer_spec
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not (norm.remove_extra_whitespaces or norm.precompiled_charsmap or spec.trainer_spec.treat_whitespace_as_suffix)
        self.safe_space = bool(plain) and not any(SPACE_MARK in p.lstrip(SPACE_MARK) or " " in p for p in pieces)
        self.safe_line = bool(plain) and not any("\n" in p and len(p) > 1 for p in pieces)
        line = "\n" if self.safe_line else ""
        self.unit = re.compile(rf"[ {SPACE_MARK}]+[^ {SPACE_MARK}{line}]*|" + rf"\n[^ {SPACE_MARK}\n]*|" * self.safe_line + rf"[^ {SPACE_MARK}{line}]+") if self.safe_space else None

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for part in by_bytes(texts, [*map(utf8_size, texts)], self.batch_bytes) for x in self.model.encode(part, num_threads=1)]

    def _learn(self, units: set[str]) -> None:
        """Puts the tokens of units inside a text into the memo. The library puts a space mark
        before every text, which stands for the first space of a unit; before a line end it
        is one token more."""
        missing = list(units - self.memo.keys())
        self.held += sum(map(utf8_size, missing))
        if len(self.memo) + len(missing) > self.memo_units or self.held > self.memo_bytes:
            self.memo.clear()
            missing = list(units)
            self.held = sum(map(utf8_size, missing))
        lengths = self._lengths([u[1:] if u[0] in (" ", SPACE_MARK) else u for u in missing])
        # the library gives no token for an empty text, which a lone space mark becomes here
        self.memo.update((u, n - 1 if u[0] == "\n" else n or 1) for u, n in zip(missing, lengths))

    def count(self, texts: list[str], sizes: list[int] | None = None) -> list[int]:
        """Tokens of each text. sizes: the texts' bytes, if they are known."""
        if self.unit is None:
            return self._lengths(texts)
        out = []
        for part in by_bytes(texts, [*map(utf8_size, texts)] if sizes is None else sizes, self.batch_bytes):
            cut = [self.unit.findall(t) for t in part]
            starts = self._lengths([u[0] if u else "" for u in cut])
            for u in cut:
                del u[:1]
            self._learn(set(chain.from_iterable(cut)))
            out += [n + sum(map(self.memo.__getitem__, u)) for n, u in zip(starts, cut)]
        return out


@lru_cache(maxsize=2)
def _counter(model_file: str) -> PieceCounter:
    return PieceCounter(model_file)


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text: one narrow pass, no shuffle."""

    def run(batches):
        counter = _counter(model_file)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(counter.count(strings(b.column("text")), b.column("n_bytes").to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
