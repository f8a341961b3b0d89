"""Encoding, decoding and token files against the libraries on whole texts."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken

from diurna.llm import bpe, textcore, tokenfile

MULTI = P.path("byte_bpe_multi_50k.tiktoken")
PLAIN = P.path("byte_bpe_50k.json")


def by_row(df, *columns):
    return sorted(((r.doc_id, *(r[c] for c in columns)) for r in df.collect()), key=str)


def test_pieces_equal_the_pattern(monkeypatch):
    random.seed(1)
    texts = ["".join(random.choice("'' \n\tstrevmldaB1,é. 　本") for _ in range(random.randint(0, 16))) for _ in range(3000)]
    for step in (64, 1 << 20):
        monkeypatch.setattr(textcore, "STEP_BYTES", step)
        data, offsets = textcore.flat(pa.array(texts))
        bounds, counts = textcore.pretokens(data, offsets)
        pieces, at = [x.as_py().decode() for x in textcore.binary_array(data, bounds)], 0
        for text, n in zip(texts, counts, strict=True):
            assert pieces[at : at + n] == regex.findall(P.PATTERN, text)
            at += n


def test_encode_and_decode(spark, odd, nothing):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(MULTI), special_tokens={})
    expected = []
    for r in odd.collect():
        ids = library.encode_ordinary(r.text or "")
        expected.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = by_row(bpe.digests(bpe.decode(bpe.encode(odd, MULTI, P.PATTERN, limit=200), MULTI)), "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(expected, key=str)
    assert bpe.encode(nothing, MULTI, P.PATTERN).count() == 0


def test_blocks_do_not_change_the_result(odd):
    a, b = (by_row(bpe.encode(odd, MULTI, P.PATTERN, limit=n), "ids") for n in (1, 1 << 23))
    assert a == b


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1000, dtype=np.uint64).astype(np.uint32)
    raw = tokenfile.pack_ids(ids, bits)
    assert len(raw) == 16 * 8 * bits and (tokenfile.unpack_ids(raw, bits, 0, 1000) == ids).all() and (tokenfile.unpack_ids(raw, bits, 130, 7) == ids[130:137]).all()


def test_file_gives_any_document(tmp_path):
    docs = [np.arange(n, dtype=np.uint32) % 50_000 for n in (0, 5, 200_000, 0, 64, 1)]
    w = tokenfile.Writer(str(tmp_path), "x", 16)
    for part in (docs[:2], docs[2:]):
        w.add(np.concatenate(part), np.array([len(d) for d in part]), pa.array([None, 7] if len(part) == 2 else [7, 8, 9, 9], pa.int64()))
    w.close()
    r = tokenfile.Reader(w.name)
    assert r.names.to_pylist() == [None, 7, 7, 8, 9, 9]
    assert r.ids == sum(map(len, docs)) and all((r.document(i) == d).all() for i, d in enumerate(docs))


def test_token_files(spark, odd, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PLAIN)
    files = tokenfile.written(tokenfile.write(odd, PLAIN, 2, tokenfile.shared_folder(spark)))
    got = sorted(tokenfile.summed(tokenfile.read(files)).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    expected = []
    for r in odd.collect():
        x = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        expected.append((r.doc_id, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(expected, key=str)
    assert tokenfile.read(tokenfile.written(tokenfile.write(nothing, PLAIN, 2, tokenfile.shared_folder(spark)))).count() == 0


def test_one_doc_id_fills_several_files_in_one_order(spark):
    docs = spark.range(400).selectExpr("5L as doc_id", "concat('text ', id) as text")
    files = [tokenfile.written(tokenfile.write(d, PLAIN, 2, tokenfile.shared_folder(spark))) for d in (docs, docs.repartition(3))]
    assert all(f.count() > 1 for f in files)
    one, two = (sorted(map(tuple, tokenfile.summed(tokenfile.read(f)).collect())) for f in files)
    assert one == two and [r[1] for r in one] == [sum(r[2] for r in one[:i]) for i in range(400)]
    reading = tokenfile.read(files[0])
    assert reading.rdd.getNumPartitions() >= files[0].count()


def test_ids_are_put_in_place_in_little_memory():
    """Many documents of short words, whose pieces hold many times their text if a block is taken at once."""
    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(4000)), "text": ["a b c d e f g h" * 128] * 4000})
    words = [{k: r[k] for k in ("block", "words")} for b in bpe.words_of(8 << 20, 1)(iter([docs])) for r in b.to_pylist()]
    ids = [r for b in bpe.encoded(MULTI, P.PATTERN)(iter([pa.RecordBatch.from_pylist(words)])) for r in b.to_pylist()]
    rows = [r | {"ids": None} for b in bpe.positions_of(8 << 20)(iter([docs])) for r in b.to_pylist()]
    kinds = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("places", pa.binary())])
    rows = pa.RecordBatch.from_pylist([r for row in rows[:1] for r in [*(i for i in ids if i["block"] == row["block"]), row]], kinds)
    tracemalloc.start()
    try:
        n = sum(len(part) for part in bpe.assembled(iter([rows])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == len(rows.column("doc_ids")[-1])
    assert peak < 64 << 20


def test_encoding_and_decoding_share_a_worker(spark):
    docs = spark.createDataFrame([(1, "It's naïve"), (2, None)], "doc_id long, text string")
    both = bpe.encode_and_decode(docs, MULTI, P.PATTERN)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 4
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, bpe.decode(bpe.encode(docs, MULTI, P.PATTERN), MULTI).collect()))
