import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from changeloom.llm import sequences
from changeloom.llm.shared import fresh

P = pytest.importorskip("public_tokenizers")
WORDS = P.path("word_bpe_49k.json")


def texts():
    return [(5, "The cat, isn't it?"), (3, None), (4, ""), (-2, "<|endoftext|> end"), (None, "no name"), (5, "The cat, isn't it?"), (5, "another of that name"), (9, "word " * 9000), (7, "日本 é\n\tx")] + [(100 + i, f"number {i} of many" * (i % 9)) for i in range(200)]


def test_files_come_back(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in texts()], "doc_id long, text string, ids string, start int").repartition(3)
    path = fresh(spark, "arrow")
    sequences.write_sequences(docs, path, WORDS, length=64, file_tokens=600)
    got = sequences.read_documents(spark, path, with_ids=True).orderBy("start").collect()
    want, at = {}, 0
    for d, t in texts():
        want.setdefault(d, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 2])
    assert [r.doc_id for r in got] == sorted((d for d, _ in texts()), key=lambda d: (d is not None, d))
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and list(r.ids) in want[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4"))
        want[r.doc_id].remove(list(r.ids))
        at += r.n_tokens
    assert not any(want.values())
    assert spark.read.format("binaryFile").load(path).where("length > 0").count() > 4


def test_random_access_copies_nothing(spark, tmp_path):
    r = np.random.default_rng(3)
    size = r.integers(1, 90, 400)
    ids = r.integers(0, 49000, size.sum()).astype(np.uint16)
    raw = sequences.arrow_file(ids, size, pa.array([None, *range(1, 400)], pa.int64()), length=32, batch=16, place=(4, 9))
    (tmp_path / "x.arrow").write_bytes(raw)
    with pa.memory_map(str(tmp_path / "x.arrow")) as m:
        one, low = sequences.Sequences(m), m.read_buffer().address
        assert len(one) == -(-len(ids) // 32) and one.place == (4, 9)
        for i in (0, 15, 16, len(one) - 1):
            a, k = one.ids(i), one.mask(i)
            n = min(32, len(ids) - 32 * i)
            assert a.tolist() == ids[32 * i : 32 * i + n].tolist() + [0] * (32 - n) and k.tolist() == [1] * n + [0] * (32 - n)
            for view in (a, k):
                assert not view.flags.owndata and low <= view.__array_interface__["data"][0] < low + raw.size
        assert [(d, s, x.tolist()) for d, s, x in one.documents()] == [(i or None, int(e - n), ids[e - n : e].tolist()) for i, (n, e) in enumerate(zip(size, np.cumsum(size), strict=True))]
        with pytest.raises(IndexError):
            one.ids(len(one))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    out = sequences.round_trip(none, WORDS)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == 0
    one = sequences.round_trip(spark.createDataFrame([(None, None)], "doc_id long, text string"), WORDS).collect()
    assert [tuple(r) for r in one] == [(None, 0, 1, zlib.crc32(np.array([2], "<u4")))]


def test_many_rows_of_one_id_are_dealt(spark):
    same = spark.range(4000).select(F.lit(1).alias("doc_id"), F.lit("again and again").alias("text"))
    got = sequences.round_trip(same, WORDS)
    assert got.agg(F.count("*"), F.countDistinct("start"), F.max("start")).first()[:] == (4000, 4000, 3999 * 4)
