import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from fernweave.llm import passages, simhash
from fernweave.llm.components import components

from .conftest import ROWS

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def plain_fingerprint(text):
    w = (text or "").encode().translate(LOWER).split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, prints, distance=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    groups: dict = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(i)
    return {i: min((ids[k] for k in g if ids[k] is not None), default=None) for g in groups.values() for i in g}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB c\n\té ", max_size=40), max_size=6))
def test_fingerprints(texts):
    got = simhash.majority(*simhash.shingle_hashes(pa.array([t.encode() for t in texts], pa.binary())))
    assert got.tolist() == [plain_fingerprint(t) for t in texts]


def test_long_text_counts_past_a_lane():
    text = " ".join(f"w{i % 37}" for i in range(5000))
    got = simhash.majority(*simhash.shingle_hashes(pa.array([text.encode()], pa.binary())))
    assert got.tolist() == [plain_fingerprint(text)]


def test_chain_keys_meet_all_near_pairs(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    pairs = []
    for i in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        pairs.append((i, a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b))
    df = spark.createDataFrame(pairs, "i long, a long, b long")
    met = df.select("i", F.arrays_overlap(simhash.chain_keys(F.col("a")), simhash.chain_keys(F.col("b"))).alias("met"))
    assert met.where("not met").count() == 0


def test_chain_filter_holds_for_near_pairs_and_drops_others():
    rng = random.Random(6)
    diffs = [sum(1 << b for b in rng.sample(range(64), n)) for n in (0, 1, 2, 3, 4) for _ in range(300)]
    passed = np.array([simhash.chained(np.array(diffs, np.uint64), s) for s in range(5)])
    assert passed.any(0).all()  # within the distance, some chain stays within its budgets
    widths, low = simhash.SEGMENTS, [0]
    for w in widths:
        low.append(low[-1] + w)
    for i, d in enumerate(diffs):
        for s in range(5):
            parts = [bin(d >> low[(s + j) % 5] & (1 << widths[(s + j) % 5]) - 1).count("1") for j in range(4)]
            assert passed[s][i] == all(sum(parts[: n + 1]) <= (n + 1) * 4 // 5 for n in range(4))
    far = np.array([rng.getrandbits(64) for _ in range(3000)], np.uint64)
    assert simhash.chained(far, 0).mean() < 0.01


def test_links_in_blocks_connect_as_all_pairs_do(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    prints = set()
    while len(prints) < 400:  # a dense group around one print, and others
        p = base if len(prints) % 2 else rng.getrandbits(64)
        for bit in rng.sample(range(64), rng.randint(0, 6)):
            p ^= 1 << bit
        prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = plain_components(list(range(len(prints))), prints)
    for block in (16, 2048):
        found = components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fingerprint long"), block=block)).collect()
        root = {r["node"]: r["root"] for r in found}
        groups = {}
        for i, p in enumerate(signed):
            groups.setdefault(root.get(p, p), []).append(i)
        assert {i: min(g) for g in groups.values() for i in g} == want


def test_near_duplicates(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    ids, prints = [r[0] for r in ROWS], [plain_fingerprint(r[1]) for r in ROWS]
    want = plain_components(ids, prints)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows], key=key) == sorted([(ids[i], signed(prints[i]), want[i]) for i in range(len(ids))], key=key)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r["root"] for r in rows})
    assert simhash.one_of_each(empty).count() == 0


def test_no_table_that_grows_is_broadcast(spark, docs, monkeypatch):
    from fernweave.operators import components as stars
    from fernweave.storage import stored

    plans = []

    def noted(df, *a):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return stored(df, *a)

    for module in (simhash, stars):
        monkeypatch.setattr(module, "stored", noted)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) >= 10 << 20
    noted(simhash.near_duplicates(docs), "out")
    distinct = spark.createDataFrame([(i,) for i in range(9)], "fingerprint long")
    noted(simhash.links(distinct), "out")
    assert sum("SortMergeJoin" in p for p in plans) > 4
    assert not [p for p in plans if "Broadcast" in p]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (200, None)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_links_need_no_rounds_and_more_give_the_same(spark, monkeypatch):
    """A chain over many partitions, a tree and a clique, in links of either direction: by one task, by rounds, and by a plain version."""
    from fernweave.operators import components as stars
    from fernweave.storage import stored

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(-200, 200)] + [(1000 + i, 1000 + i // 2) for i in range(2, 300)] + [(a, b) for a in range(5000, 5012) for b in range(5000, a)]
    edges = [rng.choice([(a, b), (b, a)]) for a, b in edges]
    rng.shuffle(edges)
    want = {i: -200 for i in range(-199, 201)} | {1000 + i: 1001 for i in range(2, 300)} | {i: 5000 for i in range(5001, 5012)}
    written = []
    monkeypatch.setattr(stars, "stored", lambda df, *a: written.append(a[0]) or stored(df, *a))
    links = spark.createDataFrame(edges, "a long, b long").repartition(9)
    for alone, rounds in ((10_000, 0), (0, 1)):
        written.clear()
        assert {r["node"]: r["root"] for r in components(links, alone).collect()} == want
        assert ("stars" in written) == bool(rounds)
    written.clear()
    assert {r["node"]: r["root"] for r in components(links).collect()} == want and written == ["links"]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)).capitalize() + "."


def plain_units(rows, min_words, paragraphs=False):
    """The spans that repeated_units() gives, by a dictionary."""
    found, seen, out = [], {}, set()
    for d, t in {(d, t) for d, t, *_ in rows if t}:
        parts = re.split(r"(\n[^\S\n]*\n\s*)" if paragraphs else r"([\r\n]+)", t)
        at = 0
        for part in parts:
            words = list(re.finditer(r"[^\x20\x09-\x0D]+", part))
            if len(words) >= max(1, min_words):
                key = " ".join(w[0] for w in words)
                found.append(((d is not None, d or 0, t, at), "".join(c.lower() if c.isascii() else c for c in key), (d, at + words[0].start(), at + words[-1].end(), len(words))))
            at += len(part)
    for place, key, _ in sorted(found, key=lambda x: x[0]):
        seen.setdefault(key, place)
    for place, key, span in found:
        if place != seen[key]:
            out.add((*span, seen[key][1] if seen[key][0] else None))
    return out


@pytest.mark.parametrize("copies", [1, 2, 3])
@pytest.mark.parametrize("min_words,paragraphs", [(1, False), (3, False), (1, True)])
def test_repeated_lines_and_paragraphs_equal_a_plain_version(spark, copies, min_words, paragraphs):
    rng = random.Random(copies)
    lines = ["yes.", "Yes.", "all  rights reserved.", "All rights\treserved.", "émile a  b c", "one two three four", "", "  "]
    rows = [(i, "".join(rng.choice(lines) + rng.choice(["\n", "\n\n", "\r\n", "\n \n"]) for _ in range(rng.randint(0, 6)))) for i in range(30)]
    rows += [(None, "yes.\nno id"), (99, None), (100, ""), (0, "another text of an id\nYES.")]
    df = spark.createDataFrame(rows * copies, "doc_id long, text string")
    got = passages.repeated_units(df, min_words, paragraphs).select("doc_id", "start", "end", "words", "kept_doc_id").collect()
    assert len(got) == len(set(got))  # a repeated row is one document
    # of one doc_id, texts rank by their hashes here and by themselves there; no kept_doc_id can tell
    assert set(map(tuple, got)) == plain_units(rows, min_words, paragraphs) or {x[:1] + x[3:] for x in map(tuple, got)} == {x[:1] + x[3:] for x in plain_units(rows, min_words, paragraphs)}


@pytest.mark.parametrize("copies", [1, 2, 3])
def test_repeated_rows_change_no_spans(spark, copies):
    rng = random.Random(8)
    rows = []
    for i in range(20):  # 13 shared words are no passage, however often their document is given; 30 are
        short, long = prose(random.Random(50), 13), prose(random.Random(51), 30)
        rows.append((i, f"{prose(rng, 30)} {short if i < 4 else ''}\n{prose(rng, 26)[:-1]} {long if i > 15 else ''} {prose(rng, 9)}"))
    found = passages.repeated_spans(spark.createDataFrame(rows * copies, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["kept_doc_id"]) for r in found) == [(17, 16), (18, 16), (19, 16)]
    text = dict(rows)
    assert all(text[r["doc_id"]][r["start"] : r["end"]].rstrip() == long for r in found)


def test_a_row_that_is_a_third_of_the_table(spark):
    rng = random.Random(9)
    passage = prose(rng, 60)
    rows = [(1, passage)] + [(2, passage)] * 400 + [(None, passage + " x")] + [(10 + i, prose(rng, 30)) for i in range(800)]
    found = passages.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r["doc_id"], r["kept_doc_id"], r["words"]) for r in found) == [(1, None, 60), (2, None, 60)]


def test_planted_passages(spark):
    rng = random.Random(4)
    passage = " ".join(prose(rng, 14) for _ in range(5))
    rows = [(i, prose(rng, 40) + "\n" + prose(rng, 30)) for i in range(30)]
    for i in (3, 11, 12, 25):  # on lines of its own, and within a line with no stop before it
        head, _, tail = rows[i][1].partition("\n")
        rows[i] = (i, f"{head}\n{passage}\n{tail}" if i % 2 else f"{head[:-1]} {passage} {tail}")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.repeated_spans(df).collect()
    assert {r["doc_id"] for r in found} == {11, 12, 25} and {r["kept_doc_id"] for r in found} == {3}
    text = dict(rows)
    for r in found:
        cut = text[r["doc_id"]][r["start"] : r["end"]]
        assert cut in passage and len(cut) > 0.8 * len(passage)
    clean = {r["doc_id"]: r["text"] for r in passages.dedup_passages(df).collect()}
    assert all(clean[i] == text[i] for i in range(30) if i not in (11, 12, 25))
    assert all(passage not in clean[i] for i in (11, 12, 25)) and passage in clean[3]


def test_passages_of_awkward_documents(docs, empty):
    clean = passages.dedup_passages(docs, min_words=5)
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    got = sorted(((r["doc_id"], r["text"]) for r in clean.collect() if r["doc_id"] in (1, 2, 9)), key=str)
    assert got[:2] == [(1, ROWS[0][1])] * 2 and got[2][0] == 2 and not got[2][1].strip()
    spans = passages.repeated_spans(docs, min_words=5).collect()
    assert any(r["doc_id"] == 8 for r in spans)  # a text repeats itself
    assert passages.repeated_spans(empty).count() == 0 and passages.dedup_passages(empty).count() == 0
    assert np.all([r["end"] > r["start"] for r in spans])


def test_near_copies_from_a_similarity_of_08(spark):
    rng = random.Random(6)
    rows, shingles = [], lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    for i in range(60):  # edits at 1 to 6 places put the pairs on both sides of 0.8
        words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        rows.append((2 * i, " ".join(words)))
        for at in rng.sample(range(5, 145), 1 + i % 6):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((2 * i + 1, " ".join(words)))
    want = set()
    for (i, a), (j, b) in zip(rows[::2], rows[1::2], strict=True):
        want |= {i} if len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b)) else {i, j}
    assert 60 < len(want) < 120
    assert {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
    data = [np.array(s, np.uint64).tobytes() for s in (range(90), range(10, 100), range(11, 101), range(500, 510))]
    a, b = simhash.spanning(4, simhash.like_sets(data))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 1), (1, 2)]


def test_passages_without_bounds_are_removed_whole(spark):
    rng = random.Random(12)
    plain = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 9))) for _ in range(n))
    rows, want = [], {}
    for i in range(80):  # 51 words without a stop or a capital, within such prose, beside different words
        passage = plain(51)
        rows.append((i, f"{plain(rng.randint(0, 40))} A {passage} é {plain(rng.randint(0, 40))}"))
        before = plain(rng.randint(0, 40)) + " B "
        rows.append((1000 + i, f"{before}{passage} ê {plain(rng.randint(0, 40))}"))
        want[1000 + i] = (len(before), len(before) + len(passage), 51, i)
    rows += [(3000, "same words " * 100), (3001, plain(200))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["start"], r["end"], r["words"], r["kept_doc_id"]) for r in passages.repeated_spans(df).collect()}
    repeats = got.pop(3000)
    assert got == want
    assert repeats[2] >= 200 - 2 * passages.MIN_WORDS and repeats[3] == 3000 and repeats[0] > 0
