import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fernweave.llm import chat
from fernweave.llm.tokens import decoder, default_tokenizer

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = (
    [(c, 0, "user", "hello") for c in range(6)]
    + [(c, 1, "assistant", "hi" if c % 2 else "hey") for c in range(5)]
    + [(c, 2, "user", f"more {c // 2}") for c in range(4)]
    + [(3, 3, "assistant", "a \\ <|im_end|>\n"), (7, 0, None, None), (8, None, "assistant", ""), (None, 0, "user", "no id"), (9, 0, "user", "x"), (9, 0, "user", "x"), (10, 5, "tool\nrole\\n", "<|<||>")]
)


@given(st.text(alphabet="\\<|>n\nim_stardé", max_size=30), st.text(alphabet="\\<|>n\nim_endé", max_size=30))
def test_turns_round_trip(role, text):
    segment = chat.format_turn(role, text)
    assert chat.parse_turn(segment) == (role, text)
    assert segment.count(chat.START) == 1 and segment.count(chat.END) == 1


def by_conversation(rows):
    out: dict = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in out.items()}


def test_read_back(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(1) for c in ("part", "seq", "rank", "hash", "key", "depth")})
    got = {r["conv_id"]: r for r in chat.read_conversations(chat.prefix_forest(df.repartition(3))).collect()}
    want = by_conversation(ROWS)
    assert got.keys() == want.keys()
    for c, turns in want.items():
        spoken = "".join(x for r, x in turns if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(spoken), hashlib.sha256(spoken.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(chat.format_turn(a, b)) for a, b in turns)
    assert chat.read_conversations(chat.prefix_forest(spark.createDataFrame([], SCHEMA))).count() == 0


def test_shared_turns_once_with_positions_and_attention(spark):
    forest = chat.prefix_forest(spark.createDataFrame(ROWS, SCHEMA).coalesce(1)).collect()
    nodes = [r.asDict(recursive=True) for r in forest if r["ids"] is not None]
    want = by_conversation(ROWS)
    prefixes = {tuple(t[: k + 1]) for t in want.values() for k in range(len(t))}
    assert len({n["part"] for n in nodes}) > 1 or len(nodes) == len(prefixes)
    assert len(prefixes) <= len(nodes) <= len(prefixes) + 4 * len({n["part"] for n in nodes})
    for part in {n["part"] for n in nodes}:
        own = sorted((n for n in nodes if n["part"] == part), key=lambda n: n["seq"])
        by_seq, end = {n["seq"]: n for n in own}, 0
        for n in own:
            assert n["start"] == end  # tokens stand one after another, depth first
            end += len(n["ids"]) // 4
        mask = chat.attention(own, end)
        for n in own:
            path, p = [], n
            while p is not None:
                path.append(p)
                p = by_seq.get(p["parent"])
            before = [t for a in path[:0:-1] for t in range(a["start"], a["start"] + len(a["ids"]) // 4)]
            assert n["position"] == len(before)
            k = len(n["ids"]) // 4
            if k:
                assert np.flatnonzero(mask[n["start"] + k - 1]).tolist() == sorted([*before, *range(n["start"], n["start"] + k)])
        loss = np.zeros(end, bool)
        for n in own:
            loss[n["loss_start"] : n["loss_end"]] = True
        tokens = np.concatenate([np.frombuffer(n["ids"], "<u4") for n in own])
        spoken = decoder(default_tokenizer()).decode(tokens[loss]).decode()
        assert chat.START not in spoken and chat.END not in spoken


@pytest.mark.parametrize("column", ["position", "start", "intervals"])
def test_a_forest_that_does_not_agree_is_refused(spark, column):
    forest = chat.prefix_forest(spark.createDataFrame(ROWS, SCHEMA).coalesce(1))
    wrong = {"position": F.col("position") + 1, "start": F.col("start") + 1, "intervals": F.expr("transform(intervals, x -> named_struct('start', x.start, 'end', x.end + 1))")}
    with pytest.raises(Exception, match="agree|no node|formatted|index"):
        chat.read_conversations(forest.withColumn(column, wrong[column])).collect()


def test_query_and_sql_agree(spark, tmp_path):
    rows = [r for r in ROWS if r[0] not in (9, None)]  # SQL leaves the order of equal turns open
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat.op9_chat(spark, str(tmp_path))
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema] == [x.replace("long", "bigint") for x in chat.READ.split(", ")]
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(chat.OP9_SQL).fetchall())


def test_more_turns_than_the_key_holds(spark, monkeypatch):
    monkeypatch.setattr(chat, "KEY_TURNS", 2)
    rows = [(c, t, "user", f"{t} {c // 2 if t > 2 else 0}") for c in range(6) for t in range(5)]
    got = {r["conv_id"]: r["turns_sha256"] for r in chat.read_conversations(chat.prefix_forest(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {c: hashlib.sha256("".join(f"user\n{t} {c // 2 if t > 2 else 0}\n" for t in range(5)).encode()).hexdigest() for c in range(6)}
