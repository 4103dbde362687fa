"""Corpus operators against brute force on small fixtures with nulls, ties, repeats, hot groups."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import SF, assert_same

SCHEMA = "doc_id long, text string, source string"


def corpus(seed=1, n=260):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "delta.", "été", "中文", "the", "of", "x|y", "#tag", "<s>", "don't", "  ", "\t", "end."]
    lines = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(25)]
    base = "\n".join(rng.choices(lines, k=9))
    rows = []
    for i in range(n):
        k = rng.random()
        if k < 0.3:
            t = base  # a third are copies
        elif k < 0.45:
            t = base.replace("alpha", "omega", 1) + f" tail{i}"
        elif k < 0.8:
            t = "\n".join(rng.choices(lines, k=rng.randint(1, 12)))
        elif k < 0.85:
            t = None
        elif k < 0.9:
            t = ""
        elif k < 0.95:
            t = "word " * rng.randint(1, 400)
        else:
            t = "".join(rng.choices("ab \n", k=rng.randint(0, 3000)))
        rows.append((i if rng.random() < 0.95 else None, t, rng.choice(["s1", "s2", None, "hot", "hot", "hot"])))
    rows += rows[:3]  # repeated rows
    rows.append((10_000, "long words " * 30_000, "s1"))
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *names):
    return sorted([tuple(r[n] for n in names) for r in df.collect()], key=repr)


@pytest.mark.parametrize("name", ["op2_line_dedup", "op9_quality_rules", "op10_source_mix"])
def test_sql(spark, name):
    from waygrid.llm import queries

    assert_same(queries.queries()[name](spark, SF), queries.oracle_sql()[name])


def test_sharding(docs, rows, empty):
    from waygrid.llm.sharding import communication_matrix, hypergeometric, shard_digest

    d = shard_digest(docs).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in d if r.doc_id is not None) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows if i is not None)
    by = {}
    for r in d:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert len(by) == 8 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sorted(map(repr, shard_digest(docs).collect())) == sorted(map(repr, d))  # reruns agree
    assert shard_digest(empty).count() == 0
    m = communication_matrix([5, 0, 17, 1], 4, 3)
    assert m.sum(1).tolist() == [5, 0, 17, 1] and sorted(m.sum(0)) == [5, 6, 6, 6]
    rng = np.random.Generator(np.random.PCG64(0))
    x = np.array([hypergeometric(rng, 30, 70, 20) for _ in range(4000)])
    assert abs(x.mean() - 6) < 0.15 and abs(x.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.4
    assert hypergeometric(rng, 0, 9, 4) == 0 and hypergeometric(rng, 9, 0, 4) == 4 and hypergeometric(rng, 3, 1, 4) == 3


def test_shards_hold_whole_rows(spark, docs, rows, empty):
    from waygrid.llm.sharding import shard_digest, shard_documents

    wide = docs.select("*", F.create_map(F.lit("k"), F.col("source")).alias("m"), F.lit(7).alias("row"))
    out = shard_documents(wide)
    assert out.columns == [*wide.columns, "shard", "slot"]
    found = out.collect()
    assert sorted(((r.doc_id, r.text, r.source) for r in found), key=repr) == sorted(map(tuple, rows), key=repr)
    assert all(r.m == {"k": r.source} and r["row"] == 7 for r in found)
    places = lambda d: sorted(((r.doc_id, r.shard, r.slot) for r in d), key=repr)
    assert places(found) == places(shard_documents(wide).collect()) and len({(r.shard, r.slot) for r in found}) == len(rows)
    assert places(shard_documents(docs).collect()) == places(shard_digest(docs).collect())
    assert all(f"/shard={s}/" in "".join(out.inputFiles()) for s in range(8))
    assert shard_documents(empty).count() == 0
    with pytest.raises(ValueError):
        shard_documents(docs.withColumn("slot", F.lit(1)))


def brute_lines(rows):
    space, seen = " \t\n\x0b\f\r", {}
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(space))
    low = -(1 << 63)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            seen.setdefault(key(x), set()).add(low if i is None else i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(key(x)) >= 20 and len(seen[key(x)]) >= 3 and max(seen[key(x)]) != (low if i is None else i))]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup(spark, docs, rows, empty):
    from waygrid.llm.line_dedup import dedup_digest, dedup_lines

    names = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got(dedup_digest(docs), *names) == brute_lines(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "37"):  # hot lines span many ranges
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert got(dedup_digest(docs), *names) == brute_lines(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dedup_digest(empty).count() == 0
    clash = docs.select("*", F.lit(1).alias("doc"), F.lit("x").alias("lines"), F.lit(2).alias("h1"), F.lit(0).alias("n_chars"))
    out = dedup_lines(clash)
    assert out.columns == clash.columns and out.count() == len(rows) and out.where("n_chars != char_length(text)").count() == 0


def test_token_counts(docs, rows, empty):
    import sentencepiece

    from waygrid.llm.common import tokenizer_path
    from waygrid.llm.token_counts import PieceCounter, count_tokens

    file = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=file)
    want = sorted([(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t, _ in rows], key=repr)
    assert got(count_tokens(docs, file), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert count_tokens(empty, file).count() == 0
    rng, bits = random.Random(5), ["a", "b", " ", "\n", "▁", "<s>", "é", "中", "\r", "\t", "  ", "word", "👍", " the", "\x00", "<unk>"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(3000)]
    small = PieceCounter(file, memo_units=50, batch_bytes=300)
    assert small.count(texts) == [len(x) for x in sp.encode(texts)]


def test_byte_bpe(docs, rows, empty):
    import public_tokenizers

    from waygrid.llm.byte_bpe import ByteBpe, decode_documents, encode_documents
    from waygrid.llm.common import tokenizer_path

    file = tokenizer_path("byte_bpe_50k.tiktoken")
    plain = ByteBpe(file, public_tokenizers.PATTERN, part_chars=1 << 30)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = plain.library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    enc = encode_documents(docs, file, public_tokenizers.PATTERN)
    assert got(enc, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert sorted(bytes(r.raw) for r in decode_documents(enc, file, public_tokenizers.PATTERN).collect()) == sorted((t or "").encode() for _, t, _ in rows)
    assert encode_documents(empty, file, public_tokenizers.PATTERN).count() == 0
    cut, rng = ByteBpe(file, public_tokenizers.PATTERN, part_chars=7), random.Random(2)
    for _ in range(1500):
        t = "".join(rng.choices(["a", " ", "\n", "'s", "1", "é", "中", "  ", "!", " ", " ", "the"], k=rng.randint(0, 60)))
        ids = cut.encode(t)
        assert ids.tolist() == plain.library.encode_ordinary(t) and cut.decode(ids) == t.encode()


def test_token_files(spark, docs, rows, empty, tmp_path):
    import pyarrow as pa
    import xxhash

    from waygrid.llm import token_files
    from waygrid.llm.common import tokenizer_path

    file = tokenizer_path("word_bpe_49k.json")
    encoder = token_files.WordEncoder(file)
    model = encoder.model
    assert encoder.by_word and encoder.by_letters
    tie = lambda t: 42 if t is None else xxhash.xxh64_intdigest(t.encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(t.encode(), 42) >> 63)
    ordered = sorted(((i, t) for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])))
    start, want, whole = 0, [], []
    for i, t in ordered:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        whole.append((i, start, ids.tobytes()))
        start += len(ids)
    clash = docs.select("*", F.lit(1).alias("ids"), F.lit(2).alias("tie"), F.lit(3).alias("start"))
    assert got(token_files.token_file_digest(clash, file), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert token_files.token_file_digest(empty, file).count() == 0
    # small blocks with checkpoints: documents go on over several blocks
    token_files.write_token_files(docs, file, f"{tmp_path}/small", 2, part_ids=20_000, block_ids=9_000, checkpoint=2_048)
    blocks = spark.read.parquet(f"{tmp_path}/small/blocks").collect()
    assert max(r.n_ids for r in blocks) == 9_000 and any(not r.doc_ids for r in blocks) and any(len(token_files.Coder.opened(r.payload)[0]) > 3 for r in blocks)
    back = token_files.read_token_files(spark, f"{tmp_path}/small").collect()
    assert sorted(((r.doc_id, r.start, bytes(r.ids)) for r in back), key=repr) == sorted(whole, key=repr)
    bad = spark.read.parquet(f"{tmp_path}/small/blocks").withColumn("crc", F.col("crc") + 1)
    bad.write.parquet(f"{tmp_path}/bad/blocks")
    spark.read.parquet(f"{tmp_path}/small/tables").write.parquet(f"{tmp_path}/bad/tables")
    with pytest.raises(Exception, match="checksum"):
        token_files.read_token_files(spark, f"{tmp_path}/bad").count()
    rng, bits = random.Random(3), ["a", " ", "\n", "<|endoftext|>", "é", "é", "中", "\r", "\t", "Word", " the", "'s", "\x00", "\x01", "\x1c", "́", "Σ", "1", "İ", ".", ",!", "H", "\u0331", "ﬁ", "K"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 20))) for _ in range(3000)]
    exact = [model.encode(t, add_special_tokens=False).ids for t in texts]
    for change in ({}, {"by_letters": False}, {"by_word": False}):
        small = token_files.WordEncoder(file, memo_words=40, batch_bytes=200)
        vars(small).update(change)
        found = [x for _, part in small.encode(pa.array([None, *texts, ""])) for x in part.to_pylist()]
        assert [np.frombuffer(b, small.dtype).tolist() for b in found] == [[], *exact, []]


def test_what_proves_word_cuts():
    import copy
    import json

    import public_tokenizers

    from waygrid.llm.token_files import letters_are_words, white_space_cuts

    spec = json.load(open(public_tokenizers.path("word_bpe_49k.json")))
    assert white_space_cuts(spec) and letters_are_words(spec)
    assert not white_space_cuts(json.load(open(public_tokenizers.path("byte_bpe_50k.json"))))
    for change in (
        lambda d: d["added_tokens"][0].update(lstrip=True), lambda d: d["added_tokens"][0].update(content="a b"), lambda d: d["normalizer"]["normalizers"].append({"type": "Strip"}),
        lambda d: d["pre_tokenizer"]["pretokenizers"][0].update(behavior="Isolated"), lambda d: d["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex=r"\s?\p{L}+"),
    ):
        other = copy.deepcopy(spec)
        change(other)
        assert not white_space_cuts(other) and not letters_are_words(other)
    other = copy.deepcopy(spec)
    other["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"] = True
    assert white_space_cuts(other) and not letters_are_words(other)


def test_rans_round_trip():
    from waygrid.llm.token_files import CHECKPOINT, Coder, quantised

    rng = np.random.default_rng(0)
    ids = (rng.pareto(1, 600_000) * 3).astype(np.int64).clip(0, 49_000).astype("<u4")
    freq = quantised(np.bincount(ids))
    assert freq.sum() == 1 << 20 and (freq[np.unique(ids)] > 0).all()
    coder = Coder(freq)
    for n in (0, 1, 2047, 2048, 2049, 100_001, CHECKPOINT, CHECKPOINT + 1, 2 * CHECKPOINT, len(ids)):
        assert (coder.decode(coder.encode(ids[:n]), n) == ids[:n]).all()
    payload = coder.encode(ids)
    assert sorted(Coder.opened(payload)[0]) == [0, CHECKPOINT, 2 * CHECKPOINT]
    for a, b in ((CHECKPOINT, 2 * CHECKPOINT), (2 * CHECKPOINT, len(ids)), (CHECKPOINT, CHECKPOINT + 77)):
        assert (coder.decode(payload, len(ids), a, b) == ids[a:b]).all()
    p = np.bincount(ids) / len(ids)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() / 8
    assert len(payload) < 1.15 * entropy * len(ids)
    assert quantised(np.array([10**9] + [1] * 50_000)).min() >= 1 and quantised(np.zeros(3)).sum() == 0


def brute_passages(rows, length=50):
    low, first = -(1 << 63), {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            k, v = b[p : p + length], low if i is None else i
            if v < first.get(k, 1 << 63):
                first[k] = v
    out = []
    for i, t, *_ in rows:
        b, v = (t or "").encode(), low if i is None else i
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < v:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(gone)) if gone[p] and (not p or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_passages(docs, rows, empty, monkeypatch):
    from waygrid.llm import passage_dedup

    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = brute_passages(rows)
    assert got(passage_dedup.dedup_passages(docs), *names) == want
    assert passage_dedup.dedup_passages(empty).count() == 0
    clash = docs.select("*", F.lit(1).alias("batch"), F.lit(2).alias("payload"), F.lit(3).alias("n_bytes"))
    kept = passage_dedup.dedup_passages(clash).collect()
    assert all(r.kept is None if not r.n_removed else hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in kept) and any(r.n_removed for r in kept)
    monkeypatch.setattr(passage_dedup, "HOT", 2)  # anchors are split by a second one
    assert got(passage_dedup.dedup_passages(docs), *names) == want
    monkeypatch.setattr(passage_dedup, "PIECE", 333)
    data = np.frombuffer("".join((t or "") for _, t, _ in rows[:60]).encode(), np.uint8)
    start, n, _ = passage_dedup.runs_of(data, np.array([len(data)]))
    assert n.sum() == len(data) - 49 and (start[1:] == start[:-1] + n[:-1]).all()


def test_passages_with_a_hot_anchor(spark, monkeypatch):
    """One string with ever new surroundings, some of which recur; long texts without a line end."""
    from waygrid.llm import passage_dedup

    rng, rows = random.Random(12), []
    noise = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    common = "the least of all hashes"
    shared = [noise(40) + common + noise(30) for _ in range(5)]
    for i in range(120):
        rows.append((i, noise(rng.randint(0, 90)) + common + noise(rng.randint(0, 90)) + (rng.choice(shared) if i % 3 else "") + noise(20), None))
    rows.append((500, "a" * 3000 + noise(5000) + shared[0], None))
    rows.append((501, "a" * 700 + shared[1] + "b" * 200, None))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = brute_passages(rows)
    for hot in (passage_dedup.HOT, 20):
        monkeypatch.setattr(passage_dedup, "HOT", hot)
        assert got(passage_dedup.dedup_passages(docs), *names) == want


def test_intervals_are_those_of_sorted_suffixes():
    from waygrid.llm.passage_dedup import STOP, intervals, window_minima

    rng = random.Random(4)
    data = bytes([STOP]).join("".join(rng.choices("ab", k=rng.randint(1, 40))).encode() for _ in range(30)) + bytes([STOP])
    for length in (1, 2, 5, 9):
        order, first = intervals(np.frombuffer(data, np.uint8), length)
        groups, at = {}, np.cumsum(first)
        for row, p in enumerate(order):
            s = data[p : p + length]
            if len(s) == length and STOP not in s:
                groups.setdefault(s, set()).add(int(at[row]))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
    a, b = window_minima([b"x" * 60, b"x" * 55 + b"y" * 5], np.array([7, 3]))
    assert a.tolist() == [3] * 11 and b.tolist() == [3] * 11


def test_only_texts_that_may_share_a_window_are_transformed(monkeypatch):
    """Texts around one 16-byte string, most of which share no window with another."""
    import pyarrow as pa

    from waygrid.llm import passage_dedup

    rng = random.Random(31)
    noise = lambda n: bytes(rng.choices(b"abcdefghijklmnop ", k=n))
    part = noise(50)
    texts = [noise(rng.randint(50, 90)) for _ in range(40)] + [noise(9) + part, part + noise(70), part, b"a" * 51]
    windows = [{t[i : i + 50] for i in range(len(t) - 49)} for t in texts]
    want = [any(a & b for k, b in enumerate(windows) if k != j) or len(a) < len(texts[j]) - 49 for j, a in enumerate(windows)]
    assert passage_dedup.may_share(texts).tolist() == want and sum(want) == 4

    seen = []  # the pieces of a bucket meet here, by one key
    rows = [(1, b"".join(texts), np.array([*map(len, texts)], np.int32).tobytes(), np.ones(len(texts), "<u4").tobytes(), np.arange(100, 100 + len(texts)).tobytes()), (2, texts[0] + part, np.array([len(texts[0]), 50], np.int32).tobytes(), np.ones(2, "<u4").tobytes(), np.array([7, 300]).tobytes())]
    minima = passage_dedup.window_minima
    monkeypatch.setattr(passage_dedup, "window_minima", lambda t, low: seen.extend(t) or minima(t, low))
    frags = pa.table({"bucket": pa.array([0, 0], pa.int32()), "batch": [r[0] for r in rows], "payload": pa.array([passage_dedup.zstandard.compress(r[1]) for r in rows], pa.binary()), "lens": pa.array([r[2] for r in rows], pa.binary()), "keys": pa.array([r[3] for r in rows], pa.binary()), "ids": pa.array([r[4] for r in rows], pa.binary())})
    found = passage_dedup.meet_in_bucket((0,), frags).to_pydict()
    assert sorted(seen) == sorted(texts[-4:])
    first = {}
    for _, raw, lens, _, ids in rows:
        at = 0
        for n, d in zip(np.frombuffer(lens, np.int32).tolist(), np.frombuffer(ids, np.int64).tolist()):
            for i in range(at, at + n - 49):
                first[raw[i : i + 50]] = min(first.get(raw[i : i + 50], d), d)
            at += n
    for (_, raw, lens, _, ids), n, mask in zip(rows, found["n"], found["mask"]):
        gone, at = [], 0
        for size, d in zip(np.frombuffer(lens, np.int32).tolist(), np.frombuffer(ids, np.int64).tolist()):
            gone += [first[raw[i : i + 50]] < d for i in range(at, at + size - 49)]
            at += size
        assert np.unpackbits(np.frombuffer(mask, np.uint8), count=n).astype(bool).tolist() == gone and any(gone)


def test_quality(docs, rows, empty):
    from waygrid.llm.quality_rules import clean_documents, judge, quality_digest, repeated_words

    def brute(w):
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})

    rng = random.Random(6)
    for _ in range(200):
        w = rng.choices("abcde", k=rng.randint(0, 40))
        assert repeated_words(w) == brute(w)
    assert quality_digest(docs).count() == len(rows) and quality_digest(empty).count() == 0
    v = judge(None)
    assert (v.n_words, v.base_failed, v.kept) == (0, True, False)
    prose = " ".join(f"word{i} and{i}." for i in range(60))
    assert judge(prose).kept and judge(prose + "\nHome | News | About | Contact").text == prose
    assert not judge("\n".join(f"Home{i} | News{i} | About{i}" for i in range(60))).kept
    assert judge("a\nb\na\n\n\x0b").n_dup_lines == 1
    for furniture in ("Read more about our privacy policy.", "Alle Rechte vorbehalten.", "Lire la suite et tous droits réservés.", "Leer más sobre la POLÍTICA DE COOKIES.", "Start • Über uns • Kontakt", "Inicio · Noticias · Contacto"):
        v = judge(prose + "\n" + furniture)
        assert v.kept and v.text == prose and v.n_lost_lines == 1, furniture
    # one very long line: a phrase or the words of a language that recur don't lose it
    long = " ".join(rng.choices([f"word{i}" for i in range(400)], k=9000)) + ". Read more in the terms of use."
    assert judge(long).kept and judge(long).text == long
    assert not judge(("buy now " * 40 + "\n") * 3 + ("read more. " * 90)).kept
    kept = clean_documents(docs.withColumn("kept", F.lit(True)).withColumn("n_chars", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "source", "kept", "n_chars"] and kept.where("n_chars != char_length(text)").count() == 0


def test_quality_on_labels(spark):
    from waygrid.llm.common import read_table
    from waygrid.llm.quality_rules import quality_digest

    sf = "/root/testdata/sf0.01"
    d = quality_digest(read_table(spark, sf, "documents")).join(read_table(spark, sf, "labels"), "doc_id").where("not base_failed")
    r = d.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {x.quality: x.kept for x in r}
    assert share[1] >= 0.99 and share.get(0, 0) <= 0.05


def test_mix(docs, rows, empty):
    from waygrid.llm.source_mix import mix_documents, mixed_documents, shard_quotas

    d = mix_documents(docs).collect()
    assert len(d) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in d)
    sources = {}
    for r in d:
        s = sources.setdefault((r.source_size, r.target), [0, 0])
        s[0] += r.taken
        s[1] += r["size"]
        assert sum(map(int, r.shard_words.split(","))) == r.taken and abs(r.copies - r.taken / max(1, r["size"])) < 1
    for (size, target), (taken, own) in sources.items():
        assert own == size and abs(taken - target) <= 5 and target <= 3 * size
        mine = [r for r in d if (r.source_size, r.target) == (size, target) and r["size"]]
        assert abs(sum(r.copies for r in mine) - sum(r.taken / r["size"] for r in mine)) <= 1
    assert sum(t for _, t in sources) == pytest.approx(sum(r["size"] for r in d))
    assert mix_documents(empty).count() == 0 and mixed_documents(empty).count() == 0
    clash = docs.select("*", F.lit(0).alias("size"), F.lit(0).alias("taken"), F.lit(0).alias("copies"), F.lit(0).alias("row"))
    out = mixed_documents(clash)
    assert out.columns == clash.columns
    words = out.select(F.sum(F.regexp_count("text", F.lit("[^ \t\n]+")))).first()[0]
    assert words > 0
    seated = docs.sparkSession.createDataFrame([(0, 5), (1, 0), (2, 9)], "src int, seats int")
    q = shard_quotas(seated, 4).groupBy("shard").agg(F.sum("quota").alias("n")).collect()
    assert sum(r.n for r in q) == 14 and max(r.n for r in q) - min(r.n for r in q) <= 1


def test_shards_take_their_quotas_of_blocks(spark):
    from waygrid.llm import source_mix

    plan = spark.createDataFrame([(0, 7, 17, [5, 5, 11, 17]), (1, 9000, 4000, [1000, 1000, 3999, 4000]), (2, 3, 0, [0, 0, 0, 0])], "src int, n_blocks long, take long, ends array<long>")
    rows = source_mix.chosen_blocks(plan, 10, 3).collect()
    for src, n_blocks, take, ends in ((0, 7, 17, [5, 5, 11, 17]), (1, 9000, 4000, [1000, 1000, 3999, 4000]), (2, 3, 0, [0, 0, 0, 0])):
        mine = [r for r in rows if r.src == src]
        assert [sum(r.shard == k for r in mine) for k in range(4)] == [b - a for a, b in zip([0, *ends], ends)]
        times = np.bincount([r.block for r in mine], minlength=n_blocks)
        assert len(times) == n_blocks and times.sum() == take and times.max(initial=0) - times.min() <= 1
    first = [r.block for r in rows if r.src == 1 and r.shard == 0]
    assert 3000 < np.mean(first) < 6000  # a seeded draw, not the first ones


def test_mix_without_words(spark):
    from waygrid.llm.source_mix import mix_documents

    d = mix_documents(spark.createDataFrame([(1, None, "a"), (2, " ", None), (None, "", "b")], SCHEMA)).collect()
    assert [(r["size"], r.taken, r.target) for r in d] == [(0, 0, 0.0)] * 3


def shingle_bag(t):
    import re
    from collections import Counter

    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def brute_classes(texts):
    bag = [shingle_bag(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = sum((bag[i] & bag[j]).values())
            alike = both and both >= 0.8 * (sum(bag[i].values()) + sum(bag[j].values()) - both)
            if alike or (texts[i] or "") == (texts[j] or ""):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_copies(spark, empty):
    from waygrid.llm.near_dedup import first_of_each, near_digest

    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = rng.choices(vocab, k=rng.randint(20, 200))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3, 15])):  # a chain of edits, so that the ends differ
            base = list(base)
            for _ in range(rng.choice([1, 1, 2, 6])):
                base[rng.randrange(len(base))] = rng.choice(vocab)
            texts.append(" ".join(base))
    texts += ["der " * 300, "der " * 290, "der " * 100, "one two", "one two", "one  two", None, "", " ", "x", texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = brute_classes(texts)
    r = near_digest(docs).collect()
    assert {x.doc_id: x.class_id for x in r} == dict(enumerate(want))
    assert sorted(x.doc_id for x in r if x.kept) == sorted(set(want))
    more = docs.unionByName(docs.limit(5)).select("*", F.lit("n").alias("node"), F.lit("s").alias("sig"), F.lit(1).alias("doc"))
    one = first_of_each(more)
    assert one.columns == more.columns and sorted(x.doc_id for x in one.collect()) == sorted(set(want))
    assert near_digest(empty).count() == 0 and first_of_each(empty).count() == 0
    null = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert near_digest(null).count() == 3 and first_of_each(null).count() == 2


def test_signatures_estimate_weighted_jaccard():
    from waygrid.llm.near_dedup import signatures

    rng = np.random.default_rng(2)
    n, m = 40, 4096
    shingle = rng.integers(1, 1 << 62, n).astype(np.uint64)
    a, b = rng.integers(1, 60, n), rng.integers(1, 60, n)
    sig = signatures(np.repeat([0, 1], n), np.concatenate([shingle, shingle]), np.concatenate([a, b]), 2, m)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / m)
    assert np.isfinite(sig).all() and np.isinf(signatures(np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int), 2, 8)).all()
    # first times of a total weight are exponential
    assert abs(sig[0].mean() * a.sum() - 1) < 0.08


def test_vector_search(spark):
    from waygrid.llm.vector_search import nearest

    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    x[500:900] = x[500]  # hot: equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9020, [0.0] * 24), (9040, [float("nan")] * 24), (9060, [1.0]), (None, x[0].tolist()), (20, x[20].tolist())]
    r = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.pmod("vec_id", F.lit(20)) == 0).collect()
    found = {}
    for y in r:
        found.setdefault(y.query_id, []).append((y["rank"], y.vec_id, y.score))
    hit = total = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -np.round(s, 9)))[:20]
        mine = sorted(found[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(abs(m[2] - s[m[1]]) < 1e-9 for m in mine)
        hit += len({m[1] for m in mine} & set(best.tolist()))
        total += 20
    assert set(found) == set(range(0, 1500, 20)) and hit / total >= 0.9
    tiny = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(y) for y in nearest(tiny, F.pmod("vec_id", F.lit(20)) == 0).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 0.0)]
    assert nearest(tiny.limit(0), F.pmod("vec_id", F.lit(20)) == 0).count() == 0


def test_vector_queries_in_blocks(spark, monkeypatch):
    from waygrid.llm import vector_search

    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = F.col("vec_id") % 5 == 0
    one = sorted(vector_search.nearest(df, asked).collect())
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 7)
    many = sorted(vector_search.nearest(df, asked).collect())
    assert [r[:3] for r in one] == [r[:3] for r in many] and len(one) == 1200
    assert [r.score for r in one] == pytest.approx([r.score for r in many], abs=1e-12)


def test_vector_ties_go_to_the_smaller_id(spark):
    from waygrid.llm.vector_search import nearest

    is_query = F.pmod("vec_id", F.lit(20)) == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], 7, "x") for i in range(45)], "vec_id long, embedding array<double>, rank int, score string")
    found = {}
    for r in nearest(same, is_query).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in (0, 20, 40):
        assert [v for _, v in sorted(found[q])] == [i for i in range(45) if i != q][:20]


def test_counts_beside_clashing_columns(docs, rows):
    import public_tokenizers

    from waygrid.llm.byte_bpe import encode_documents
    from waygrid.llm.common import tokenizer_path
    from waygrid.llm.token_counts import count_tokens

    clash = docs.select("*", F.lit(-1).alias("n_bytes"), F.lit(-1).alias("n_tokens"), F.lit("x").alias("ids"))
    sizes = sorted(((i, len((t or "").encode())) for i, t, _ in rows), key=repr)
    assert got(count_tokens(clash, tokenizer_path("piece_bpe_32k.model")), "doc_id", "n_bytes") == sizes
    enc = encode_documents(clash, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert enc.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and enc.where("n_tokens < 0").count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    from waygrid.llm.common import read_table
    from waygrid.llm.quality_rules import judge

    sf, docs = SF, read_table(spark, SF, "documents")
    names = docs.columns
    q = corpus_pipeline.quality_rules(spark, docs, sf)
    assert sorted(r.doc_id for r in q.collect()) == sorted(r.doc_id for r in docs.collect() if judge(r.text).kept)
    lined = corpus_pipeline.line_dedup(spark, q, sf)
    assert lined.count() == q.count() and lined.columns == names
    want = brute_lines([(r.doc_id, r.text) for r in q.collect()])
    assert sorted(((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in lined.collect()), key=repr) == [(i, h) for i, _, _, h in want]
    near = corpus_pipeline.near_dedup(spark, lined, sf)
    rows = sorted((r.doc_id, r.text) for r in lined.collect())
    classes = brute_classes([t for _, t in rows])
    assert sorted(r.doc_id for r in near.collect()) == sorted(rows[c][0] for c in set(classes)) and near.columns == names
    mixed = corpus_pipeline.source_mix(spark, near, sf)
    assert mixed.columns == names and mixed.count() > 0
    out = corpus_pipeline.byte_bpe(spark, mixed, sf)
    assert {r.doc_id: r.decoded_sha256 for r in out.collect()} == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in mixed.collect()}
    assert corpus_pipeline.run(spark, sf).count() == mixed.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "mixing to target weights", "byte-level BPE"]
