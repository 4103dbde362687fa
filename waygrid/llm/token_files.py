"""Token-ID files: a static range asymmetric numeral system (rANS).

One frequency table, from the ids of all documents, is shared by all blocks. Ids stand in
ascending doc_id order, cut into blocks of `BLOCK` ids. In a block, `LANES` coders take
turns (id i belongs to lane i mod LANES), so encoding and decoding work on whole rows of
lanes at once. Each block is independent: it has its own CRC-32, the documents that start
in it, and a checkpoint (all lanes' states and the place in the stream) every
`CHECKPOINT` ids. Blocks are decoded each by itself, wherever they lie, and a block from all its
checkpoints at once. Only documents that go on in another block are put together afterwards.

File format: Parquet, written by Spark's committer to the shared folder, so a lost
executor leaves no half-written file and no block. `tables/` has (id, freq), `blocks/` a
row for each block: part, block, n_ids, crc, owner (the block where the document begins that
its first ids belong to), lead (how many), payload, doc_ids, doc_lens. The payload is
  u32 lanes, u32 words, u32 checkpoints; u64 states of all lanes before the first id;
  for each checkpoint: u32 id, u32 word, u64 states; u32 words of the stream; all
  little-endian.

Null and empty texts have the end id only. Null doc_id sorts first; rows with equal
doc_id stand in the order of their text's hash. Columns beside doc_id and text aren't used.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waygrid.llm.common import by_bytes, dropped, saved, work_dir

SCALE, LANES, BLOCK, CHECKPOINT = 20, 2048, 1 << 20, 1 << 18
LOW = np.uint64(1 << 31)


def white_space_cuts(spec: dict) -> bool:
    """Whether a tokenizer file proves that ids of a text are those of its parts between spaces and
    line ends: it normalises characters one by one or by NFC (into which neither enters), drops
    what its pattern doesn't match, no alternative of the pattern matches white space or looks
    around, and no added token holds any or reaches over it. Nothing else is believed."""
    steps = lambda x, many: [y for z in x[many] for y in steps(z, many)] if x and x["type"] == "Sequence" else [x] if x else []
    spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    plain = all(n["type"] in ("NFC", "Lowercase") or n == spaces for n in steps(spec["normalizer"], "normalizers"))
    first = (steps(spec["pre_tokenizer"], "pretokenizers") or [{"type": ""}])[0]
    drops = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"]
    classes = (r"[\p{L}]+", r"\p{L}+", r"[\p{N}]", r"[\p{N}]+", r"[^\s\p{L}\p{N}]+")
    alone = drops and all(x in classes or re.fullmatch(r"['A-Za-z0-9]+", x) for x in first["pattern"].get("Regex", " ").split("|"))
    added = all(not (re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
    return plain and bool(alone) and added and not spec["truncation"] and not spec["padding"]


def letters_are_words(spec: dict) -> bool:
    """Whether the file proves moreover that ASCII letters, in lower case, reach the model as one
    piece and unchanged, and are cut from signs that follow them."""
    pre, norm = json.dumps(spec["pre_tokenizer"]), json.dumps(spec["normalizer"])
    parts = spec["pre_tokenizer"].get("pretokenizers", [])
    bytes_only = [p for p in parts[1:] if p["type"] != "ByteLevel" or p["add_prefix_space"] or p["use_regex"]] == []
    pattern = parts[0]["pattern"]["Regex"].split("|") if parts and "Regex" in pre else []
    own = r"[\p{L}]+" in pattern and r"[^\s\p{L}\p{N}]+" in pattern and all(x[0] in "'[" for x in pattern)
    return white_space_cuts(spec) and len(parts) == 2 and bytes_only and own and "Lowercase" in norm


class WordEncoder:
    """Ids of texts by the tokenizers library. Where the file proves that white space cuts
    (`white_space_cuts`), words of a batch are numbered in Arrow, those that aren't in a bounded memo
    are encoded together, with a mark between them, and the ids are gathered in Arrow. Words of
    ASCII letters go to the library's model itself, where that is proven to be the same
    (`letters_are_words`). Else whole texts are encoded."""

    MARK, TAIL = "\x01", ".,;:!?"

    def __init__(self, file: str, memo_words: int = 800_000, batch_bytes: int = 1 << 23):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(file)
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo: dict[str, bytes] = {}
        self.memo_words, self.batch_bytes = memo_words, batch_bytes
        spec = json.loads(self.model.to_str())
        self.by_word, self.by_letters, self.bpe = white_space_cuts(spec), letters_are_words(spec), self.model.model
        mark = self.model.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def _ids(self, found) -> bytes:
        return np.array(found.ids, self.dtype).tobytes()

    def _learn(self, words: list[str]) -> None:
        memo, missing = self.memo, []
        unknown = [w for w in words if w not in memo]
        if len(memo) + len(unknown) > self.memo_words:
            memo.clear()
            unknown = words
        for w in unknown:
            core = w.rstrip(self.TAIL)
            if not (self.by_letters and core.isalpha() and core.isascii()):
                missing.append(w)
                continue
            found, tail = memo.get(low := core.lower()), w[len(core) :]
            if found is None:
                found = memo[low] = np.array([t.id for t in self.bpe.tokenize(low)], self.dtype).tobytes()
            if tail and tail not in memo:
                memo[tail] = self._ids(self.model.encode(tail, add_special_tokens=False))
            memo[w] = found + memo[tail] if tail else found
        parts = [missing[i : i + 512] for i in range(0, len(missing), 512)]
        between = f" {self.MARK} "
        for part, found in zip(parts, self.model.encode_batch_fast([between.join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(found.ids, self.dtype)
            cuts = np.flatnonzero(ids == self.mark) if self.mark is not None else ()
            if len(cuts) == len(part) - 1:  # else a word holds the mark itself
                raw, size = ids.tobytes(), self.dtype.itemsize
                starts = [0, *((cuts + 1) * size).tolist()] if len(part) > 1 else [0]
                ends = [*(cuts * size).tolist(), len(raw)] if len(part) > 1 else [len(raw)]
                self.memo.update(zip(part, [raw[s:e] for s, e in zip(starts, ends)]))
            else:
                self.memo.update((w, self._ids(self.model.encode(w, add_special_tokens=False))) for w in part)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
        """(place of the first text, little-endian ids of each text, of the encoder's dtype), part by
        part of about batch_bytes. Null counts as empty."""
        texts = pc.fill_null(texts, "")
        at = 0
        for sizes in by_bytes(sizes := pc.binary_length(texts).to_pylist(), sizes, self.batch_bytes):
            part, at = texts.slice(at, len(sizes)), at + len(sizes)
            if not self.by_word:
                yield at - len(sizes), pa.array([self._ids(x) for x in self.model.encode_batch_fast(part.to_pylist(), add_special_tokens=False)], pa.binary())
                continue
            words = pc.split_pattern(pc.replace_substring(part, "\n", " "), " ")
            flat = words.flatten().dictionary_encode()
            known = flat.dictionary.to_pylist()
            self._learn(known)
            ids = pa.array(map(self.memo.__getitem__, known), pa.large_binary()).take(flat.indices)
            ends = np.frombuffer(ids.buffers()[1], "<i8", len(ids) + 1) if len(ids) else np.zeros(1, "<i8")
            cuts = ends[np.asarray(words.offsets) - words.offsets[0].as_py()]
            yield at - len(sizes), pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(cuts.tobytes()), ids.buffers()[2] if len(ids) else pa.py_buffer(b"")])
            if sum(sizes) > 2 * self.batch_bytes:  # one long text: its words may be long too
                self.memo.clear()


@lru_cache(maxsize=2)
def _encoder(file: str) -> WordEncoder:
    return WordEncoder(file)


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE, one at least for each id that occurs."""
    counts = counts.astype(np.float64)
    total, size = counts.sum(), 1 << SCALE
    if not total:
        return np.zeros(len(counts), np.uint64)
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts * (size / total))), 0).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    off = size - int(freq.sum())
    if off >= 0:
        freq[order[0]] += off
    while off < 0:  # taken evenly from those that have more than one slot
        rich = order[freq[order] > 1]
        take = np.minimum(freq[rich] - 1, np.maximum(1, freq[rich] * -off // freq[rich].sum()))
        take = take * (np.cumsum(take) <= -off)
        freq[rich] -= take
        off += int(take.sum())
    return freq.astype(np.uint64)


class Coder:
    def __init__(self, freq: np.ndarray, checkpoint: int = CHECKPOINT):
        self.freq, self.checkpoint = freq.astype(np.uint64), checkpoint
        self.first = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    def encode(self, ids: np.ndarray) -> bytes:
        lanes = min(LANES, max(1, len(ids)))
        x = np.full(lanes, LOW)
        words, total, marks = [], 0, {}
        apart = max(1, self.checkpoint // lanes) * lanes
        for at in range((max(0, len(ids) - 1) // lanes) * lanes, -1, -lanes) if len(ids) else ():
            row = ids[at : at + lanes]
            f, y = self.freq[row], x[: len(row)]
            full = y >= f << np.uint64(63 - SCALE)
            words.append((y[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            total += len(words[-1])
            y = np.where(full, y >> np.uint64(32), y)
            high = y // f
            x[: len(row)] = (high << np.uint64(SCALE)) + (y - high * f) + self.first[row]
            if at and at % apart == 0:
                marks[at] = (total, x.copy())
        head = np.array([lanes, total, len(marks)], "<u4").tobytes() + x.astype("<u8").tobytes()
        for at in sorted(marks):
            after, states = marks[at]
            head += np.array([at, total - after], "<u4").tobytes() + states.astype("<u8").tobytes()
        return head + b"".join(w.tobytes() for w in reversed(words))

    @staticmethod
    def opened(payload: bytes) -> tuple[dict[int, tuple[int, np.ndarray]], np.ndarray]:
        """(place in the stream and states for each id from which decoding can start, the stream)."""
        lanes, total, n_marks = np.frombuffer(payload, "<u4", 3).tolist()
        starts, at = {0: (0, np.frombuffer(payload, "<u8", lanes, 12))}, 12 + 8 * lanes
        for _ in range(n_marks):
            where, word = np.frombuffer(payload, "<u4", 2, at).tolist()
            starts[where] = (word, np.frombuffer(payload, "<u8", lanes, at + 8))
            at += 8 + 8 * lanes
        return starts, np.frombuffer(payload, "<u4", total, at)

    def _run(self, starts: list[tuple[int, np.ndarray]], words: np.ndarray, n: int) -> np.ndarray:
        """The next n ids from each start: all starts advance together, a row of lanes a step."""
        x = np.stack([states for _, states in starts]).astype(np.uint64)
        pos = np.array([p for p, _ in starts], np.int64)
        out = np.empty((len(starts), n), "<u4")
        low, lanes = np.uint64((1 << SCALE) - 1), x.shape[1]
        for i in range(0, n, lanes):
            y = x[:, : n - i]
            slot = y & low
            row = self.symbol[slot]
            out[:, i : i + lanes] = row
            y = self.freq[row] * (y >> np.uint64(SCALE)) + slot - self.first[row]
            at, lane = np.nonzero(y < LOW)
            taken = np.bincount(at, minlength=len(starts))
            nth = np.arange(len(at)) - np.repeat(np.cumsum(taken) - taken, taken)
            y[at, lane] = (y[at, lane] << np.uint64(32)) | words[pos[at] + nth]
            pos += taken
            x[:, : n - i] = y
        return out

    def decode(self, payload: bytes, n: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids of a block of n ids, from `start` (0 or a checkpoint) to `stop`."""
        starts, words = self.opened(payload)
        stop = n if stop is None else stop
        marks = [s for s in sorted(starts) if start <= s < stop]
        if not marks:
            return np.empty(0, "<u4")
        size = marks[1] - marks[0] if len(marks) > 1 else stop - start
        alike = [s for s in marks if s + size <= stop]  # all but the last part
        out = [*self._run([starts[s] for s in alike], words, size)]
        if len(alike) < len(marks):
            out += [*self._run([starts[marks[-1]]], words, stop - marks[-1])]
        return np.concatenate(out)


def token_ids(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, tie (hash of the text), ids (binary) of every document."""

    def run(batches):
        encoder = _encoder(tokenizer_file)
        for b in batches:
            for i, ids in encoder.encode(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, len(ids)), b.column("tie").slice(i, len(ids)), ids.cast(pa.binary())], ["doc_id", "tie", "ids"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    return slim.mapInArrow(run, "doc_id long, tie long, ids binary")


def id_counts(tokens: DataFrame, tokenizer_file: str) -> DataFrame:
    """id, n over the ids of all documents; each task sends a row for each id at most."""

    def run(batches):
        total, dtype = np.zeros(0, np.int64), _encoder(tokenizer_file).dtype
        for b in batches:
            found = np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), dtype), minlength=len(total))
            found[: len(total)] += total
            total = found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids], pa.int64())], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


BLOCK_SCHEMA = "part int, block int, n_ids int, crc long, owner int, lead int, payload binary, doc_ids array<long>, doc_lens array<long>"


def write_token_files(docs: DataFrame, tokenizer_file: str, path: str, end_id: int | None = None, part_ids: int = 8_000_000, block_ids: int = BLOCK, checkpoint: int = CHECKPOINT) -> None:
    """Encodes whole texts, appends end_id to each, and writes tables/ and blocks/ to path."""
    spark = docs.sparkSession
    tokens = saved(token_ids(docs, tokenizer_file), "token-ids")
    counts = {r.id: r.n for r in id_counts(tokens, tokenizer_file).collect()}  # a row for each id of the vocabulary at most
    if end_id is not None:
        counts[end_id] = counts.get(end_id, 0) + tokens.count()
    n = np.zeros(max(counts, default=0) + 1, np.int64)
    for i, c in counts.items():
        n[i] = c
    freq = quantised(n)
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id int, freq long").coalesce(1).write.parquet(f"{path}/tables")

    def run(batches):
        part, coder, dtype = TaskContext.get().partitionId(), Coder(freq, checkpoint), _encoder(tokenizer_file).dtype
        end = np.array([] if end_id is None else [end_id], dtype).tobytes()
        width, full = dtype.itemsize, block_ids * dtype.itemsize
        waiting, size, block, doc_ids, doc_lens, owner, lead = [], 0, 0, [], [], 0, 0

        def row(raw: bytes):
            ids = np.frombuffer(raw, dtype).astype("<u4")
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "n_ids": pa.array([len(ids)], pa.int32()), "crc": pa.array([zlib.crc32(ids.tobytes())], pa.int64()),
                 "owner": pa.array([owner], pa.int32()), "lead": pa.array([min(lead, len(ids))], pa.int32()),
                 "payload": pa.array([coder.encode(ids)], pa.binary()), "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())), "doc_lens": pa.array([doc_lens], pa.list_(pa.int64()))}
            )

        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                raw = ids + end
                waiting.append(raw)
                doc_ids.append(doc_id)
                doc_lens.append(len(raw) // width)
                size += len(raw)
                while size >= full:
                    raw = b"".join(waiting)
                    yield row(raw[:full])
                    owner = block if doc_ids else owner  # what is left belongs to the last document that began
                    waiting, size, block, doc_ids, doc_lens, lead = [raw[full:]], size - full, block + 1, [], [], (size - full) // width
        if doc_ids or size:
            yield row(b"".join(waiting))

    parts = max(8, int(n.sum()) // part_ids)
    ordered = tokens.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    ordered.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")
    dropped(tokens)


def read_token_files(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, with keep_ids, ids (binary) of every document,
    decoded from the files; raises an error if a block's checksum is wrong."""
    table = spark.read.parquet(f"{path}/tables").collect()  # the vocabulary at most
    freq = np.zeros(max((r.id for r in table), default=0) + 1, np.uint64)
    for r in table:
        freq[r.id] = r.freq
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    schema = "part int, owner int, block int, doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    kinds = [pa.int32()] * 3 + [pa.int64()] * 4 + [pa.binary()]

    def run(batches):
        """A row for each document that ends where it begins; else one for each block that has
        some of it, with the ids (no doc_id, start, n_tokens but in the first)."""
        coder = Coder(freq)
        for b in batches:
            for part, block, n, crc, owner, lead, payload, ids, lens in zip(*[b.column(c).to_pylist() for c in ("part", "block", "n_ids", "crc", "owner", "lead", "payload", "doc_ids", "doc_lens")]):
                raw = memoryview(coder.decode(payload, n).tobytes())
                if zlib.crc32(raw) != crc:
                    raise ValueError(f"part {part}: the checksum of block {block} is wrong")
                rows = [(part, owner, block, None, None, None, None, raw[: 4 * lead].tobytes())] * (lead > 0)
                at = lead
                for doc, size in zip(ids, lens):
                    piece = raw[4 * at : 4 * (at + size)]
                    whole = at + size <= n
                    rows.append((part, block, block, doc, at, size, zlib.crc32(piece) if whole else None, piece.tobytes() if keep_ids or not whole else None))
                    at += size
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], [x.split()[0] for x in schema.split(", ")])

    def joined(batches):
        for b in batches:
            pieces = [b"".join(p["ids"] for p in x) for x in b.column("pieces").to_pylist()]
            columns = [pa.array([zlib.crc32(p) for p in pieces], pa.int64()), pa.array(pieces if keep_ids else [None] * len(pieces), pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("block"), b.column("doc_id"), b.column("start"), b.column("n_tokens"), *columns], ["part", "block", "doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    names = ["part", "block", "doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    found = saved(blocks.mapInArrow(run, schema), "token-documents")
    split = found.where("ids_crc32 is null").groupBy("part", "owner").agg(F.max("doc_id").alias("doc_id"), F.max("start").alias("start"), F.max("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("block", "ids"))).alias("pieces"))
    split = split.withColumnRenamed("owner", "block").mapInArrow(joined, "part int, block int, doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    sizes = blocks.groupBy("part", "block").agg(F.sum("n_ids").alias("n"))  # a row for each block
    in_part = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    of_part = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("parts_before"))
    before = sizes.select("part", "block", in_part.alias("before")).join(of_part, "part")
    out = found.where("ids_crc32 is not null").select(names).unionByName(split).join(before, ["part", "block"]).withColumn("start", F.col("start") + F.col("before") + F.col("parts_before"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * keep_ids)


def token_file_digest(docs: DataFrame, tokenizer_file: str, end_id: int = 2) -> DataFrame:
    path = f"{work_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, tokenizer_file, path, end_id)
    return read_token_files(docs.sparkSession, path, keep_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
