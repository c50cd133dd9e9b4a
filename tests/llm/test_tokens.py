import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fernweave.llm import bitpack, packing
from fernweave.llm.tokens import default_tokenizer, encoder

from .conftest import ROWS


def plain(texts):
    return [x.ids for x in encoder(default_tokenizer()).tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r  é'sAb1.!<|"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5))
def test_memo_equals_the_library(texts):
    flat, count = encoder(default_tokenizer()).encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])][: len(texts)] == plain(texts) if texts else not len(flat)


def test_special_strings_are_text():
    flat, _ = encoder(default_tokenizer()).encode(pa.array(["<|endoftext|>"]))
    assert 50256 not in flat.tolist()


@given(st.integers(1, 32), st.data())
@settings(max_examples=60, deadline=None)
def test_bits_round_trip(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=300)), np.uint32)
    assert bitpack.unpack_bits(bitpack.pack_bits(ids, bits), bits, len(ids)).tolist() == ids.tolist()


@pytest.mark.parametrize("bits,block", [(16, 8), (13, 8), (13, 5), (1, 64), (17, 7)])
def test_file_random_access(bits, block):
    rng = np.random.default_rng(bits)
    counts = np.array([0, 3, 50, 1, 0, 21])
    ids = rng.integers(0, 2**bits, counts.sum()).astype(np.uint32)
    file = bitpack.PackedFile(bitpack.write_file([5, None, 7, -1, 0, 9], counts, ids, bits, block))
    assert file.doc_ids == [5, None, 7, -1, 0, 9]
    for a in range(0, len(ids) + 1, 3):
        for b in range(a, len(ids) + 1, 7):
            assert file.ids(a, b).tolist() == ids[a:b].tolist()
    assert file.document(2).tolist() == ids[3:53].tolist()
    with pytest.raises(IndexError):
        file.ids(0, len(ids) + 1)


def test_ids_too_large_are_refused():
    with pytest.raises(ValueError):
        bitpack.write_file([1], np.array([1]), np.array([8], np.uint32), 3)


def test_packed_files(docs, empty):
    files = bitpack.packed_files(docs, file_ids=64)
    ids = [[*x, 2] for x in plain([r[1] for r in ROWS])]
    want = sorted(((r[0], x) for r, x in zip(ROWS, ids, strict=True)), key=str)
    read = bitpack.read_documents(files).collect()
    assert sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in read), key=str) == want
    at, crc = 0, {zlib.crc32(np.array(x, "<u4").tobytes()): x for x in ids}
    got = sorted(bitpack.placed(files).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] is not None and r["doc_id"] for r in got] == sorted(r[0] is not None and r[0] for r in ROWS)  # null first; in any order within an id
    for row in got:
        assert (row["start"], row["n_tokens"]) == (at, len(crc[row["ids_crc32"]]))
        at += row["n_tokens"]
    assert sorted(((r["doc_id"], crc[r["ids_crc32"]]) for r in got), key=str) == want
    assert bitpack.placed(bitpack.packed_files(empty)).count() == 0


def test_a_hot_doc_id_is_dealt_out(spark):
    from pyspark.sql import functions as F

    rows = [(None, "the same")] * 400 + [(i, f"text {i}") for i in range(800)]
    files = bitpack.packed_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), file_ids=8)
    null = bitpack.read_documents(files).where("doc_id is null").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(r["n"] for r in null) == 400
    found = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert found.where("doc_id is null").select("salt").distinct().count() == 400


def test_query_has_the_contracts_columns(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = bitpack.op4_packed_ids(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")] and out.count() == len(ROWS)
    out = packing.op2_packing(spark, str(tmp_path))
    want = {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    assert {c: t for c, t in out.dtypes if c in want} == dict.fromkeys(want, "bigint")


def test_class_sizes_match_the_column_form(spark):
    for length in (64, 128, 2048):
        sizes = packing.class_sizes(length)
        got = spark.range(1, length + 1).select("id", packing.class_of(F.col("id"), length).alias("c")).collect()
        for r in got:
            assert r["c"] == np.searchsorted(sizes, r["id"]), (length, r)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=40))
def test_cutting_stock_meets_demand(lengths):
    sizes, demand = np.unique(lengths, return_counts=True)
    plan = packing.cutting_stock(sizes, demand, 100)
    assert (sum(p * n for p, n in plan) == demand).all()
    assert all((p * sizes).sum() <= 100 for p, _ in plan)
    assert sum(n for _, n in plan) <= 2 * -(-sum(lengths) // 100) + 1


def test_cutting_stock_is_near_the_bound():
    rng = np.random.default_rng(3)
    bounds = packing.class_sizes(256)
    sizes, demand = np.unique(bounds[np.searchsorted(bounds, np.clip(rng.lognormal(3.5, 1, 20_000).astype(int), 1, 255))], return_counts=True)
    used = sum(n for _, n in packing.cutting_stock(sizes, demand, 256))
    assert used <= 1.01 * (sizes * demand).sum() / 256 + len(sizes) / 2


def test_pack(spark, docs, empty):
    found = packing.pieces(docs)
    rows = packing.pack(found, carry=["ids"]).collect()
    want = sorted(zlib.crc32(np.array([*x, 1], "<u4").tobytes()) for x in plain([r[1] for r in ROWS]))
    by_doc: dict = {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    whole = []
    for (_, n), parts in by_doc.items():
        parts.sort(key=lambda r: r["start"])
        copies = sum(p["start"] == 0 for p in parts)
        assert sum(p["length"] for p in parts) == n * copies
        if copies == 1:
            whole.append(zlib.crc32(b"".join(p["ids"] for p in parts)))
        else:
            whole += [zlib.crc32(bytes(p["ids"])) for p in parts]
    assert sorted(whole) == want
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    built = packing.sequences(found).collect()
    assert sum(len(r["ids"]) for r in built) == 4 * sum(r["length"] for r in rows)
    assert packing.pack(packing.pieces(empty)).count() == 0
