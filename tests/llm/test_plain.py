"""Queries without SQL, and the pipeline, against versions in plain Python; and the columns of the contracts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from fernweave.llm import mixing, passages, queries, sharding, toxicity
from fernweave.llm.tokens import default_tokenizer

from .test_sharding_mixing import filled

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8))) for _ in range(n))


def first(d):
    """Null doc_ids come first."""
    return (d is not None, d or 0)


def plain_model(docs, labels):
    text = {}
    for d, t, *_ in docs:
        if d is not None:
            text[d] = min(text.get(d, t or ""), t or "")
    worst = {}
    for d, y in labels:
        if d in text and y is not None:
            worst[d] = max(worst.get(d, 0), y)
    return toxicity.fit([text[d] for d in sorted(worst)], [worst[d] for d in sorted(worst)])


def plain_grade(model, text):
    has = set()
    for w in re.findall(r"[^\W_]+", (text or "").lower()):
        has |= {w} | {w[:n] + "~" for n in (4, 5, 6, 7) if len(w) > n}
    score = sum(model.weights.get(f, 0.0) for f in has)
    above = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
    chance = [a - b for a, b in zip([1.0, *above], [*above, 0.0], strict=True)]
    return int(np.argmax(chance)), sum(above), int(sum(above) >= toxicity.REJECT and score > 0)


def toxic_corpus(rng, n=160):
    rows = [(i, prose(rng, rng.randint(40, 90)), "en", f"s{i % 3}", 0) for i in range(n)]
    for i in range(0, n, 5):
        rows[i] = (i, rows[i][1] + " vileword" + (" nastyword" if i % 2 else ""), *rows[i][2:])
    return rows, [(i, int(i % 5 == 0)) for i in range(n) if i % 3]


def written(spark, path, docs, labels):
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(d, 1, y) for d, y in labels], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_toxicity_equals_a_plain_scorer(spark, tmp_path):
    docs, labels = toxic_corpus(random.Random(3))
    docs += [(None, None, None, None, None), (None, "vileword", None, None, None), (7, docs[7][1], "en", "s1", 0), (900, "", "en", "s1", 0)]
    model = plain_model(docs, labels)
    got = toxicity.op3_toxicity(spark, written(spark, tmp_path, docs, labels)).collect()
    want = sorted(((d, *plain_grade(model, t)) for d, t, *_ in docs), key=lambda r: (first(r[0]), r[2]))
    have = sorted(((r["doc_id"], r["severity_grade"], r["expected_severity"], r["toxic"]) for r in got), key=lambda r: (first(r[0]), r[2]))
    assert [(r[0], r[1], r[3]) for r in have] == [(r[0], r[1], r[3]) for r in want]
    assert [r[2] for r in have] == pytest.approx([r[2] for r in want], abs=1e-9)
    assert {r[0] for r in have if r[3]} - {None} == set(range(0, 160, 5))


def plain_ring(rows, shards):
    """Each key on its own: clockwise from its place to the next virtual node whose shard has room."""
    bits, nodes = sharding.RING_BITS, {}
    for shard in range(shards):
        for k in range(sharding.VIRTUAL_NODES):
            digest = hashlib.blake2b(f"{shard}:{k}".encode(), digest_size=16).digest()
            nodes.setdefault(int.from_bytes(digest[:8], "little") % (1 << bits), []).append((digest, shard))
    points = sorted((place, min(held)[1]) for place, held in nodes.items())
    room = [len(rows) // shards + (k < len(rows) % shards) for k in range(shards)]
    keys = []
    for d, t in rows:
        h = 42
        for part in (None if d is None else d.to_bytes(8, "little", signed=True), None if t is None else t.encode()):
            h = h if part is None else xxhash.xxh64_intdigest(part, h)
        keys.append((int(f"{h >> (64 - bits):0{bits}b}"[::-1], 2), h, first(d), zlib.crc32((t or "").encode()), d, len((t or "").encode()) + 1))
    used, out = [0] * shards, []
    for _, h, _, crc, d, size in sorted(keys):
        after = [s for p, s in points if p >= h >> (64 - bits)] + [s for _, s in points]
        shard = next(s for s in after if used[s] < room[s])
        out.append((d, size, crc, "rows", shard, used[shard], None))
        used[shard] += 1
    return out


def test_sharding_equals_a_plain_walk(spark, docs, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randint(-9, 400), prose(rng, rng.randint(0, 4))) for _ in range(250)] + [(None, None), (None, "é"), (3, None), (4, "twice"), (4, "twice")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in sharding.op5_sharding(spark, str(tmp_path)).collect()]
    key = lambda r: (first(r[0]), *r[1:3], *r[4:6])
    assert sorted(got, key=key) == sorted(plain_ring(rows, 8), key=key)


def plain_copies_kept(rows):
    """One row of each component by a Jaccard similarity of 0.8 over 5-word shingles."""
    def shingles(t):
        words = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    kept = {}
    for i, r in enumerate(rows):
        best = kept.get(find(i))
        if best is None or (r[0] is None, r[0] or 0) < (best[0] is None, best[0] or 0):
            kept[find(i)] = r
    return list(kept.values())


def plain_passages_cut(rows, n=passages.MIN_WORDS):
    """The texts without any n words that stand in an earlier document."""
    seen, out = set(), []
    for d, t, *rest in sorted(rows, key=lambda r: first(r[0])):
        words = list(WORD.finditer(t or ""))
        grams = [tuple(w[0].lower() for w in words[i : i + n]) for i in range(len(words) - n + 1)]
        cut = [False] * len(words)
        for i, g in enumerate(grams):
            if g in seen:
                cut[i : i + n] = [True] * n
        seen |= set(grams)
        text, end, i = "", 0, 0
        while i < len(words):
            if cut[i]:
                j = i
                while j < len(words) and cut[j]:
                    j += 1
                text, end, i = text + t[end : words[i].start()], words[j - 1].end(), j
            else:
                i += 1
        out.append((d, None if t is None else text + t[end:], *rest))
    return out


def plain_mix(rows):
    """How often each row is taken: whole repetitions, then rows by their hashes for as long as half a row or more has room."""
    size = lambda t: len(WORD.findall(t or ""))
    sizes = {}
    for _, t, _, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = filled(sizes, {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)})
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    out, used = Counter(), Counter()
    for d, t, _, s, *_ in sorted(rows, key=lambda r: md5(f"42|{'' if r[0] is None else r[0]}|{md5(r[1] or '')}")):
        whole = int(goal[s] // sizes[s]) if sizes[s] else 0
        room = round(goal[s]) - whole * sizes[s] - used[s]
        used[s] += size(t)
        out[d, t] += 1 if not size(t) else min(3, whole + (room * 2 >= size(t)))
    return out


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    rng = random.Random(17)
    docs, labels = toxic_corpus(rng)
    for k in range(12):  # near copies, exact copies, and a passage of 55 words in the middle of a line
        docs.append((300 + k, re.sub(r"\S+$", f"changed{k}", docs[5 * k + 1][1]), "en", "s1", 0))
    docs += [(400, docs[2][1], "en", "s0", 0), (401, docs[2][1], "en", "s2", 0)]
    for k in range(4):
        passage = prose(rng, 55)
        for j in range(3):
            docs.append((500 + 3 * k + j, f"{prose(rng, 70)} {passage} {prose(rng, 45)}", "en", f"s{j}", 0))
    docs += [(800, None, None, None, None), (None, "a text that has no id at all", None, "s1", None)]
    sf = written(spark, tmp_path, docs, labels)
    model = plain_model(docs, labels)
    want = [r for r in docs if not plain_grade(model, r[1])[2]]
    near = plain_copies_kept(want)
    assert len(want) - len(near) == 14
    cut = plain_passages_cut(near)
    assert sum(a[1] != b[1] for a, b in zip(sorted(near, key=lambda r: first(r[0])), cut, strict=True)) == 8
    mixed = plain_mix(cut)
    library, pieces = Tokenizer.from_file(default_tokenizer()), Counter()
    for (d, t), times in mixed.items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        pieces[d, len(ids)] += times
    rows = corpus_pipeline.run(spark, sf).collect()
    got, sequences = Counter(), {}
    for r in rows:
        if not r["start"]:
            got[r["doc_id"], r["doc_tokens"]] += 1
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == +pieces
    assert sum(r["length"] for r in rows) == sum(n * times for (_, n), times in pieces.items())
    for held in sequences.values():
        end = 0
        for offset, n in sorted(held):
            assert offset == end
            end += n
        assert end <= 2048


CONTRACTS = {
    "op1": "query_id bigint, rank int, vec_id bigint, score double",
    "op2": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op4": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op5": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op6": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op8": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op9": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op10": "doc_id bigint, fingerprint string, component_id bigint",
}


@pytest.mark.parametrize("op", CONTRACTS)
def test_columns_of_the_contracts(spark, op, tmp_path):
    rng = random.Random(1)
    spark.createDataFrame([(i, prose(rng, 9), "en", "a", 0) for i in range(25)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ok")], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([(i, [rng.random() for _ in range(8)]) for i in range(41)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    name = next(n for n in queries.QUERIES if n.startswith(f"{op}_"))
    out = queries.QUERIES[name](spark, str(tmp_path))
    types = dict(out.dtypes)
    assert ", ".join(f"{c} {types.get(c)}" for c in re.findall(r"(\w+) \w+", CONTRACTS[op])) == CONTRACTS[op]
    assert out.count() == {"op1": 60, "op9": 2}.get(op, 25)
