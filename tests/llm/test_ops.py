"""The ten operators: against SQL, brute force, exact round trips, planted cases and odd inputs."""

from __future__ import annotations

import json
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.llm import chunk_dedup, decontamination, exact_topk, language_id, mixing, near_dedup, queries, secret_scan, token_binary, tool_chat, url_filter, words
from oracle import connect, same


def docs_of(spark, texts, **more):
    rows = [(i, t, more.get("lang", ["en"] * len(texts))[i], f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


ODD = [None, "", " ", "!!!", "a", "a b c d e f g h " * 3000, "same text here now ok", "same text here now ok"]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def corpus(small):
    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{small}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, small, name):
    same(queries.QUERIES[name](spark, small), connect(small), queries.ORACLE_SQL[name])


# ---- 1 --------------------------------------------------------------------------------------------------------------------------


def edit_distance_within(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != t)))
        row = new
    return min(row)


def test_decontamination_equals_brute_force(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    items = [[rnd.choice(vocab) for _ in range(rnd.randint(12, 40))] for _ in range(12)]
    texts = []
    for i in range(60):
        body = [rnd.choice(vocab) for _ in range(rnd.randint(0, 80))]
        if i % 2:
            item = list(items[i % 12])
            for _ in range(rnd.randint(0, len(item) // 4)):
                at = rnd.randrange(len(item))
                item[at : at + rnd.randint(0, 1)] = [rnd.choice(vocab)]
            at = rnd.randint(0, len(body))
            body[at:at] = item
        texts.append(" ".join(body).upper() + ".")
    want = {}
    for d, t in enumerate(texts):
        for k, item in enumerate(items):
            edits = edit_distance_within(item, words.words(t))
            if edits <= int(len(item) * decontamination.MOST_EDITS + 1e-9):
                want[d, k] = edits
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontamination.leaks(docs_of(spark, texts), bench).collect()}
    assert set(got) <= set(want)
    assert all(got[x] == want[x] for x in got)
    assert len(got) >= 0.95 * len(want)
    exact = {x for x, e in want.items() if e == 0}
    assert exact <= set(got)


def test_decontamination_recall(spark, small):
    block = decontamination.blocks(spark.read.parquet(f"{small}/benchmark.parquet"))[0]
    assert decontamination.recall(block) >= 0.95


@pytest.mark.parametrize("n", [5, 6, 8, 9, 10, 12, 14, 15, 16, 18, 20, 24, 30, 60])
def test_decontamination_recall_by_length(n):
    index = decontamination.Index(list(range(20)), [" ".join(f"w{i}x{k}" for k in range(n)) for i in range(20)])
    assert decontamination.recall(index, trials=5) == 1


def test_decontamination_odd_inputs(spark, empty):
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, None), (None, "x"), (3, "short"), (1, "one two three four five six")], "item_id long, text string")
    docs = docs_of(spark, [*ODD, "zero ONE two, three four five six!"])
    got = decontamination.leaks(docs, bench).collect()
    assert [(r["doc_id"], r["item_id"], r["edits"], r["first_word"], r["n_words"]) for r in got] == [(len(ODD), 1, 0, 1, 6)]
    assert decontamination.clean(docs, bench).count() == len(ODD)
    assert decontamination.leaks(empty, bench).count() == 0
    assert decontamination.leaks(docs, bench.where("false")).count() == 0 and decontamination.clean(docs, bench.where("false")).count() == len(ODD) + 1
    assert decontamination.leaks(docs.withColumn("item_id", F.lit(1)), bench).count() == 1


# ---- 2 --------------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def forest(spark):
    return secret_scan.train(secret_scan.synthetic_findings(spark).where("id % 4 > 0"))


def test_secret_scan_held_out_accuracy(spark, forest):
    held = secret_scan.features(secret_scan.synthetic_findings(spark).where("id % 4 = 0")).withColumn("p", F.expr(forest) >= 0.5)
    right, n = held.agg(F.avg((F.col("p") == (F.col("label") == 1)).cast("double")), F.count("*")).first()
    assert n > 1000 and right > 0.97


def test_secret_scan_finds_planted(spark, small, forest):
    import re

    small = small.replace("0.001", "0.01")
    corpus = duckdb.connect().execute(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()
    rnd = random.Random(6)
    for i in range(60):  # two more kinds in ordinary texts
        key = f"password={rnd.getrandbits(72):018x}" if i % 2 else "AKIA" + "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
        own = (corpus[i][1] or "").split(" ")
        own.insert(rnd.randint(0, len(own)), key)
        corpus.append((100_000 + i, " ".join(own)))
    pattern = re.compile(r"(?<=token = \")[0-9a-f]{40}(?=\")|(?<=password=)[0-9a-f]{16,}|\bAKIA[A-Z0-9]{16}\b", re.I)
    want = {(d, m.lower()) for d, t in corpus for m in pattern.findall(t or "")}
    assert {m[:4] == "akia" for _, m in want} == {True, False}
    docs = spark.createDataFrame([(d, t, "web") for d, t in corpus], "doc_id long, text string, source string")
    found = secret_scan.candidates(docs, ["doc_id"]).select("__carry.doc_id", F.lower("candidate").alias("c"), F.sha2("candidate", 256).alias("sha256")).join(secret_scan.scan(docs, ["doc_id"], forest).select("doc_id", "sha256"), ["doc_id", "sha256"])
    got = {(r["doc_id"], r["c"]) for r in found.collect()}
    assert want and want <= got
    clean = [d for d, t in corpus if not pattern.search(t or "")]
    assert len({d for d, _ in got} & set(clean)) <= 0.005 * len(clean)
    assert len(got - want) <= 0.05 * len(want)


def test_secret_scan_odd_inputs(spark, empty, forest):
    docs = docs_of(spark, [*ODD, 'key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"'] * 2).withColumn("score", F.lit("clash")).withColumn("path", F.lit(None))
    got = secret_scan.scan(docs, ["doc_id"], forest).collect()
    assert sorted(r["doc_id"] for r in got) == [len(ODD), 2 * len(ODD) + 1]
    assert got[0]["preview"] == "9f86" and got[0]["position"] == 3 and got[0]["n_chars"] == 40
    assert secret_scan.scan(empty, ["doc_id"], forest).count() == 0


def test_secret_scan_finds_every_key_of_a_word(spark, forest):
    import hashlib

    a, b, c = (hashlib.sha1(x).hexdigest() for x in (b"a", b"b", b"c"))
    texts = [f'{{"api_token":"{a}","auth_secret":"{b}","password":"{c}"}}', f"see https://host.example.org/some-long-path/to?token={a}&secret={b} now", f'key,secret "{a}","{b}"', f"my_service_api_token={c}"]
    docs = docs_of(spark, texts)
    sha = {hashlib.sha256(x.encode()).hexdigest(): x for x in (a, b, c)}
    got = [(r["doc_id"], sha[r["sha256"]]) for r in secret_scan.scan(docs, ["doc_id"], forest).collect() if r["sha256"] in sha]
    assert sorted(got) == sorted([(0, a), (0, b), (0, c), (1, a), (1, b), (2, a), (2, b), (3, c)])


# ---- 3 --------------------------------------------------------------------------------------------------------------------------


def test_tool_chat_links_orders_and_validates(spark):
    schemas = {"add": {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "number", "minimum": 0}}, "required": ["a"], "additionalProperties": False}}
    calls = [{"id": "c1", "name": "add", "arguments": '{"b": 2, "a": 1}'}, {"id": "c2", "name": "add", "arguments": {"a": "x"}, "after": "c1"}, {"id": "c3", "name": "add", "arguments": {"a": 1}, "after": "c2"}]
    ring = [{"id": "x", "name": "add", "arguments": {"a": 1}, "after": "y"}, {"id": "y", "name": "add", "arguments": {"a": 1}, "after": "x"}, {"id": "z", "name": "no", "arguments": "{", "after": None}]
    rows = [
        (1, 5, "assistant", json.dumps({"tool_calls": calls})),
        (1, 1, "tool", json.dumps({"tool_call_id": "c1", "content": "3"})),
        (1, 9, "tool", json.dumps({"tool_call_id": "c1", "content": "late"})),
        (1, 6, "tool", json.dumps({"tool_call_id": "c3", "content": {"k": 1}})),
        (1, 7, "tool", json.dumps({"tool_call_id": "gone", "content": None})),
        (2, 0, "assistant", json.dumps({"tool_calls": ring})),
        (3, 0, "system", "hello"),
        (3, 0, "system", "hello"),
        (None, None, None, None),
    ]
    got = tool_chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("json", F.lit(1)), schemas).collect()
    by = {(r["conv_id"], r["call_id"]): r for r in got}
    assert (by[1, "c1"]["status"], by[1, "c1"]["depth"], by[1, "c1"]["n_results"]) == ("ok", 0, 2)
    assert by[1, "c1"]["json"] == '{"call":{"arguments":{"a":1,"b":2},"id":"c1","name":"add"},"result":"3"}'
    assert (by[1, "c2"]["status"], by[1, "c2"]["depth"], by[1, "c2"]["error"]) == ("invalid", 1, "$.a: not of type integer")
    assert (by[1, "c3"]["status"], by[1, "c3"]["depth"]) == ("ok", 2)
    assert by[1, "gone"]["status"] == "orphan"
    assert by[2, "x"]["status"] == by[2, "y"]["status"] == "cyclic"
    assert (by[2, "z"]["status"], by[2, "z"]["error"]) == ("invalid", "$: not JSON")
    assert sum(r["status"] == "context" for r in got) == 2


def test_tool_chat_long_chain_and_empty(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(300)] + [(2, 0, "user", "")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["depth"], r["status"]) for r in tool_chat.link(messages).collect()}
    assert all(got[1, i] == (i // 2, "ok") for i in range(0, 300, 2))
    assert got[2, 0] == (0, "invalid")
    assert tool_chat.link(messages.where("false")).count() == 0


def test_tool_chat_orders_calls_that_need_several(spark):
    """Depths and positions against a plain walk over random graphs, with rings, chains, calls that need several and missing needs."""
    rnd = random.Random(7)
    rows, needs = [], {}
    for conv in range(6):
        n = 40
        for i in range(n):
            up = [rnd.randrange(i) for _ in range(rnd.choice([0, 1, 1, 1, 2, 3]))] if i else []
            if rnd.random() < 0.04:
                up.append(rnd.randrange(n))  # may close a ring
            needs[conv, i] = set(up)
            after = [f"c{u}" for u in up] + (["gone"] if rnd.random() < 0.1 else [])
            rows.append((conv, rnd.randrange(90), "assistant", json.dumps({"tool_calls": [{"id": f"c{i}", "name": "reply", "arguments": {"text": "x"}, "after": after[0] if len(after) == 1 else after}]})))
    want, changed = {}, True
    while changed:
        changed = False
        for k, up in needs.items():
            if k not in want and all((k[0], u) in want for u in up):
                want[k], changed = max((want[k[0], u] + 1 for u in up), default=0), True
    linked = tool_chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).cache()
    got = linked.collect()
    assert {(r["conv_id"], int(r["call_id"][1:])): r["depth"] for r in got} == {k: want.get(k) for k in needs}
    assert 0 < sum(r["status"] == "cyclic" for r in got) < len(got)
    for conv in range(6):
        own = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: r["position"])
        assert [r["position"] for r in own] == list(range(1, 41))
        keys = [(r["depth"] is None, r["depth"] or 0, r["turn"]) for r in own]
        assert keys == sorted(keys)
    written = {}
    for r in tool_chat.transcripts(linked, 16).collect():
        assert r["n_lines"] == min(16, 40 - 16 * r["block"])
        written.setdefault(r["conv_id"], {})[r["block"]] = r["lines"].split("\n")
    for conv, parts in written.items():
        assert [x for _, p in sorted(parts.items()) for x in p] == [r["json"] for r in sorted((r for r in got if r["conv_id"] == conv), key=lambda r: r["position"])]


def test_tool_chat_odd_json(spark):
    deep = "[" * 100_000 + "]" * 100_000
    calls = [{"id": "a\ud800", "name": "reply", "arguments": {"text": "\udfff!"}}, {"id": "b", "name": "reply", "arguments": '{"text": NaN}'}, {"id": "b", "name": "f", "arguments": {"x": 1.0, "y": [2.5, 1]}}, {"name": "f"}, 5, {"id": "b", "name": "f", "arguments": {"x": 1.0, "y": [2.5, 1]}}]
    rows = [(1, 0, "user", '{"tool_calls": ' + deep + "}"), (1, 1, "assistant", json.dumps({"tool_calls": calls})), (1, 2, "tool", '{"tool_call_id": "a\\ud800", "content": 1e999}'), (1, 3, "tool", json.dumps({"tool_call_id": None})), (1, 5, "x", '{"tool_calls": [{"id": "d", "arguments": ' + json.dumps(deep) + "}]}")]
    got = tool_chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {}
    for r in got:
        by.setdefault((r["call_id"], r["status"]), []).append(r)
    assert by["turn-0", "unanswered"][0]["json"].startswith('{"call":{"arguments":{"text":"{')
    assert json.loads(by["a\\ud800", "unanswered"][0]["json"])["call"]["arguments"] == {"text": "\udfff!"}
    assert len(by["b", "duplicate"]) == 2
    assert [r["error"] for r in got if r["call_id"] == "d"] == ["$: not JSON"]
    assert len(by[None, "duplicate"]) == 2 and len(by[None, "orphan"]) == 1
    assert tool_chat.canonical(tool_chat.decoded('{"b":1.0,"a":[1,2.50,1e2]}')) == '{"a":[1,2.5,100],"b":1}'
    assert sorted(r["position"] for r in got) == list(range(1, len(got) + 1))


# ---- 4 --------------------------------------------------------------------------------------------------------------------------


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def expected_rows(keys, texts):
    out, start = [], 0
    for k, ids in zip(keys, reference_ids(texts), strict=True):
        out.append((k, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_equal_the_tokenizer(spark, small, corpus):
    got = [tuple(r) for r in queries.QUERIES["op4_token_binary"](spark, small).orderBy("start").collect()]
    assert got == expected_rows([d for d, _ in corpus], [t for _, t in corpus])


def test_token_files_odd_inputs(spark, empty):
    texts = [*ODD, "a  b\n\n c", "x<|endoftext|>y don't", "x <|endoftext|> y <|endoftext|", "<|endoftext|>", "tab\t x\r\n z", "\u00a0 nb\u3000 日本語 🙂.", ".a..b ,c!? d", "é. É! ñ1. 12.5"]
    docs = docs_of(spark, texts)
    odd = docs.union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).union(docs.where("doc_id = 4"))
    got = [tuple(r)[:4] for r in token_binary.tokenise(odd.withColumn("start", F.lit("clash"))).orderBy("start").collect()]
    keys = [None, *range(5), 4, *range(5, len(texts))]
    assert got == expected_rows(keys, [texts[k] if k is not None else texts[0] for k in keys])
    assert token_binary.tokenise(empty).count() == 0


def test_code_round_trip():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rnd.integers(0, 1 << 32, n) >> rnd.integers(0, 32, n)).astype(np.uint32)
        assert (token_binary.unpack(*token_binary.pack(values), n) == values).all()


# ---- 5 --------------------------------------------------------------------------------------------------------------------------


def test_chunk_dedup_finds_repeats_and_leaves_others(spark):
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    passages = [" ".join(rnd.choice(vocab) for _ in range(55)) for _ in range(20)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(30, 300))) for _ in range(120)]
    for i in range(60):
        texts[i] = texts[i][: rnd.randint(0, len(texts[i]))] + " " + passages[i % 20] + " " + texts[i]
    texts += ["start " + "again " * 70, "other " + "again " * 90 + "end", "again once"]
    got = {r["doc_id"] for r in chunk_dedup.repeats(docs_of(spark, texts)).collect()}
    assert got == {*range(60), 120, 121}


def test_chunk_ends_resist_shifts():
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 122, 5000).astype(np.uint8).tobytes()
    a = set(chunk_dedup.ends(data).tolist())
    b = {x - 7 for x in chunk_dedup.ends(b"shifted" + data).tolist()}
    assert len(a & b) > 0.97 * len(a)
    assert max(np.diff(sorted(a))) <= chunk_dedup.WINDOW
    assert 100 < len(chunk_dedup.ends(b"-" * 10_000)) < 200


def test_chunk_dedup_removes_what_came_before(spark):
    rnd = random.Random(9)
    body = ["".join(rnd.choice("äbcdeñ fghij") for _ in range(400)) for _ in range(3)]
    texts = [body[0], body[1] + body[0], None, body[0], body[2]]
    got = {r["doc_id"]: r["text"] for r in chunk_dedup.deduplicate(docs_of(spark, texts)).collect()}
    assert got[0] == body[0] and got[2] is None and got[3] == "" and got[4] == body[2]
    assert got[1].startswith(body[1]) and len(got[1]) < len(body[1]) + 120


def common_stretches(texts, least):
    """For each text, its bytes that are in a stretch of ``least`` bytes or more that stands in another text too."""
    seen = {}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        for j in range(len(data) - least + 1):
            seen.setdefault(data[j : j + least], set()).add(i)
    out = []
    for t in texts:
        data = (t or "").encode()
        own = np.zeros(len(data) + 1, dtype=int)
        for j in range(len(data) - least + 1):
            if len(seen[data[j : j + least]]) > 1:
                own[j : j + least] = 1
        out.append(own[: len(data)])
    return out


def test_chunk_dedup_equals_common_substrings(spark):
    """Every byte of a span is in a verbatim repeat, and every repeat of 260 bytes is found but for its ends."""
    rnd = random.Random(8)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(60)]
    phrases = [" ".join(rnd.choice(vocab) for _ in range(14)) for _ in range(8)]  # short repeats that are everywhere, about 90 bytes
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(1, 8)):
            parts += [rnd.choice(phrases), " ".join(rnd.choice(vocab) for _ in range(rnd.randint(3, 40)))]
        texts.append(" ".join(parts))
    passages = [" ".join(rnd.choice(vocab) for _ in range(n)) for n in (30, 55, 60, 80, 120)]
    for i in range(30):
        texts[i] = texts[i][:70] + passages[i % 5] + texts[i][70:]
    docs = docs_of(spark, texts)
    spans = chunk_dedup.repeats(docs).collect()
    shared, sure = common_stretches(texts, chunk_dedup.MIN_BYTES), common_stretches(texts, 260)
    found = [np.zeros(len(t.encode()), dtype=int) for t in texts]
    for r in spans:
        assert r["n_bytes"] >= chunk_dedup.MIN_BYTES and 0 <= r["cut_bytes"] <= r["n_bytes"] and r["is_first"] == (r["cut_bytes"] == 0)
        assert shared[r["doc_id"]][r["start"] : r["start"] + r["n_bytes"]].all()
        found[r["doc_id"]][r["start"] : r["start"] + r["n_bytes"]] = 1
    for own, hit in zip(sure, found, strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]])))
        for a, b in zip(edges[0::2], edges[1::2], strict=True):
            assert hit[a:b].any()
    # the same rows from other splits and with keys that repeat give the same spans
    again = chunk_dedup.repeats(docs.repartition(7, "source", "doc_id")).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, spans))
    twice = docs.union(docs.where("doc_id < 5")).withColumn("doc_id", F.when(F.col("doc_id") != 9, F.col("doc_id")))
    a, b = (sorted(map(tuple, chunk_dedup.repeats(x).collect()), key=str) for x in (twice, twice.repartition(5, "text")))
    assert a == b and len(a) > len(spans)


def test_chunk_dedup_odd_inputs(spark, empty):
    long_ = "word and other words that go on and on in one line of text " * 10
    got = chunk_dedup.repeats(docs_of(spark, [*ODD, long_, long_]).withColumn("owner", F.lit(1))).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["first_doc_id"], r["is_first"]) for r in got] == [(len(ODD), len(ODD), True), (len(ODD) + 1, len(ODD), False)]
    assert all(r["n_bytes"] == len(long_) and r["start"] == 0 for r in got)
    assert chunk_dedup.repeats(empty).count() == 0


# ---- 6 --------------------------------------------------------------------------------------------------------------------------


def test_topk_odd_inputs(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, None), (9, [1.0, None]), (10, [float("nan"), 1.0]), (11, [float("inf"), 1.0]), (None, [9.0, 9.0]), (12, [3.0]), (100, [2.0]), (13, [-1.5, 0.1]), (150, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = sorted(tuple(r) for r in exact_topk.top_k(df).collect())
    a = (256 * 256) * 5
    b = -384 * 256 + 25 * 512
    assert got == [(0, 1, 7, a), (0, 2, 7, a), (0, 3, 50, a), (0, 4, 13, b), (50, 1, 0, a), (50, 2, 7, a), (50, 3, 7, a), (50, 4, 13, b), (100, 1, 12, 512 * 768)]
    assert exact_topk.top_k(df.where("false")).count() == 0


def test_topk_large_products_are_exact(spark):
    big = 2.0**54
    rows = [(0, [3e6, 1 / 256]), (1, [3e6, 1 / 256]), (2, [3e6, 2 / 256]), (3, [3e6, 2 / 256]), (50, [big, -big]), (60, [big, big]), (61, [-big, big])]
    got = [tuple(r) for r in exact_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    whole = {k: [int(np.floor(256 * x)) for x in v] for k, v in rows}
    for q in (0, 50):
        scores = {k: min(max(sum(a * b for a, b in zip(whole[q], v, strict=True)), -(2**63)), 2**63 - 1) for k, v in whole.items() if k != q}
        want = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert sorted(r for r in got if r[0] == q) == [(q, i + 1, k, x) for i, (k, x) in enumerate(want)]


def test_topk_many_ties_across_cells(spark):
    rnd = np.random.default_rng(2)
    base = rnd.integers(-3, 4, (40, 24)).astype(float) / 256
    rows = [(i, base[rnd.integers(40)].tolist()) for i in range(9000)]
    got = {}
    for r in exact_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    m = np.array([v for _, v in rows]) * 256
    for q in (0, 50, 4450, 8950):
        scores = (m @ m[q]).round().astype(int)
        want = sorted((i for i in range(9000) if i != q), key=lambda i: (-scores[i], i))[:5]
        assert sorted(got[q]) == [(k + 1, i, scores[i]) for k, i in enumerate(want)]


# ---- 7 --------------------------------------------------------------------------------------------------------------------------


def test_mixing_reaches_targets(spark):
    docs = spark.createDataFrame([(i, "x" * 10, "a" if i % 10 else "b") for i in range(20_000)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 9.0)], "src string, weight double")
    out = mixing.mix(docs, targets)
    n = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["a"] - 20_000 / 13) / (20_000 / 13) < 0.1 or abs(n["a"] / n["b"] - 1 / 3) < 0.05
    keys = [r["shuffle_key"] for r in out.select("shuffle_key").collect()]
    assert keys == sorted(keys)


def test_mixing_large_means(spark):
    rates = mixing.with_table(spark.createDataFrame([("a", 10, 1700.0)], "src string, mass long, rate double")).first()
    assert rates["parts"] == 4 and abs(rates["cdf"][-1] - 1) < 1e-9
    docs = spark.createDataFrame([(0, "x", "a"), *[(i, "yyyyyyyyyy", "b") for i in range(1, 500)]], "doc_id long, text string, source string")
    n = mixing.mix(docs).where("source = 'a'").count()
    assert abs(n - 2495) < 300


def test_mixing_odd_inputs(spark, empty):
    docs = docs_of(spark, ODD).withColumn("source", F.when(F.col("doc_id") < 4, F.lit(None)).otherwise(F.lit("s"))).withColumn("copy", F.lit("clash"))
    out = mixing.mix(docs.union(docs.withColumn("doc_id", F.lit(None).cast("long"))))
    assert set(out.columns) == {*docs.columns, "shuffle_key"}
    assert out.count() > 0
    blank = mixing.mix(docs_of(spark, [None, ""]))
    assert blank.count() > 0  # sources without characters are kept at rate 1
    assert mixing.mix(empty).count() == 0


# ---- 8 --------------------------------------------------------------------------------------------------------------------------


def test_language_id_held_out_accuracy(spark, small):
    docs = spark.read.parquet(small.replace("0.001", "0.01") + "/documents.parquet")
    languages, logs = language_id.fit(docs.where("doc_id % 2 = 0"), "doc_id", "text", "lang")
    got = language_id.identify(docs.where("doc_id % 2 = 1"), languages, logs, F.lit(None), F.lit(None), ["doc_id", "lang"])
    right, accepted = got.agg(F.avg((F.col("language") == F.col("lang")).cast("double")), F.avg(F.col("accepted").cast("double"))).first()
    assert right > 0.99 and accepted > 0.99


def test_language_id_evidence_decides_short_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("lang IN ('fr', 'en')")
    languages, logs = language_id.fit(docs, "doc_id", "text", "lang")
    texts = docs.select("doc_id", "text", F.concat("lang", F.lit(".example."), "lang").alias("host"), F.concat(F.lit('<html lang="'), "lang", F.lit('">')).alias("markup"))
    unclear = spark.createDataFrame([(-1, "n", "fr.example.fr", '<html lang="fr">'), (-2, "n", "en.example.en", "<html lang='en'>")], texts.schema)
    got = {r["doc_id"]: r["language"] for r in language_id.identify(texts.union(unclear), languages, logs, F.col("host"), language_id.declared_language(F.col("markup")), ["doc_id"]).where("doc_id < 0").collect()}
    assert got == {-1: "fr", -2: "en"}


def test_language_id_of_pages_equals_plain_fusion(spark, small):
    """The whole fusion, recomputed row by row with dictionaries."""
    from collections import Counter

    docs = spark.read.parquet(f"{small}/documents.parquet")
    languages, logs = language_id.fit(docs, "doc_id", "text", "lang")
    n, pages = len(languages), spark.read.parquet(f"{small}/pages.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "http://a.b.example.org/x", "<html " + "x" * 500 + " lang=en><p>the and of the</p>"), (-3, "x", "<p>123</p>"), (-3, "x", "<p>123</p>")], "page_id long, url string, html string")
    pages.union(odd).write.mode("overwrite").parquet((folder := f"{language_id.Scratch(spark, 'pages').base}") + "/pages.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    got = sorted(((r["page_id"], r["language"], r["posterior"], r["accepted"]) for r in language_id.language_id_pages(spark, folder).collect()), key=str)
    plain = url_filter.host_and_path(spark.read.parquet(f"{folder}/pages.parquet")).select("page_id", "host", language_id.declared_language(F.col("html")).alias("declared"), F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ").alias("plain"))
    rows = []
    for r in plain.collect():
        buckets, _ = language_id.trigrams([r["plain"]])
        seen = buckets[buckets >= 0][: None]
        ll = logs[seen].sum(axis=0, dtype=np.float64) * min(len(seen), language_id.EFFECTIVE_TRIGRAMS) / max(len(seen), 1) if len(seen) else None
        suffix = r["host"].rsplit(".", 1)[-1] if "." in r["host"] else None
        rows.append((r["page_id"], r["host"], ".".join(r["host"].split(".")[-2:]), r["declared"], suffix, ll, None if ll is None else int(np.argmax(ll[:n]))))
    assert [x[3] for x in rows if x[0] == -2] == ["en"]
    judged = [x for x in rows if x[6] is not None]

    def prior(counts, parent, least):
        total = sum(counts.values())
        return [(counts[i] + least * parent[i]) / (total + least) for i in range(n)]

    top = prior(Counter(x[6] for x in judged), [1 / n] * n, n)
    want = []
    for key, host, domain, declared, suffix, ll, _ in rows:
        if ll is None:
            want.append((key, "und", None, False))
            continue
        of_domain = prior(Counter(x[6] for x in judged if x[2] == domain), top, language_id.PRIOR_ROWS)
        host_prior = prior(Counter(x[6] for x in judged if x[1] == host), of_domain, language_id.PRIOR_ROWS)
        likes = []
        for column, value in ((3, declared), (4, suffix)):
            known = [x for x in judged if x[column] is not None]
            kinds = len({x[column] for x in known})
            likes.append([0.0] * n if value is None else [np.log((sum(x[6] == i and x[column] == value for x in known) + 1) / (sum(x[6] == i for x in known) + kinds)) for i in range(n)])
        joint = [ll[i] + likes[0][i] + likes[1][i] + np.log(host_prior[i] * (1 - language_id.UNKNOWN_PRIOR)) for i in range(n)]
        joint.append(ll[n] + sum(likes[0]) / n + sum(likes[1]) / n + np.log(language_id.UNKNOWN_PRIOR))
        best = int(np.argmax(joint))
        posterior = 1 / sum(np.exp(np.array(joint) - joint[best]))
        name = [*languages, "und"][best]
        want.append((key, name, posterior, name != "und" and posterior >= language_id.LEAST_POSTERIOR))
    want.sort(key=str)
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
    assert all((p is None) == (q is None) and (p is None or abs(p - q) < 2e-5) for (_, _, p, _), (_, _, q, _) in zip(got, want, strict=True))


def test_language_id_odd_inputs(spark, empty):
    docs = docs_of(spark, [*ODD, *["this is the text of that"] * 5], lang=[None] * len(ODD) + ["en"] * 5).withColumn("language", F.lit("clash")).withColumn("source", F.lit(None).cast("string"))
    got = {r["doc_id"]: (r["language"], r["accepted"]) for r in language_id.identify_documents(docs, ["doc_id"]).collect()}
    assert len(got) == len(ODD) + 5
    clash = docs.withColumn("accepted", F.lit(1)).withColumn("posterior", F.lit(2))
    assert sorted(language_id.identify_documents(clash, clash.columns).columns) == sorted([*docs.columns, "accepted", "posterior"])
    assert all(got[i] == ("und", False) for i in range(4)) and got[len(ODD)] == ("en", True)
    assert language_id.identify_documents(empty, ["doc_id"]).count() == 0
    assert not language_id.identify_documents(docs.withColumn("lang", F.lit(None).cast("string")), ["doc_id"]).where("accepted").count()


# ---- 9 --------------------------------------------------------------------------------------------------------------------------


def test_url_filter_odd_inputs(spark):
    urls = [None, "", "no scheme", "http://", "http://X.EXAMPLE.org/es/a?b#c", "ftp://example.org?/es/", "a://b://c/d", "http://badexample.org/es/", "http://org/", "http://x.com/de", "http://x.com/de/", "http://ÄB.com/fr/x\ny#z", "http://example.org/en/1234"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] * 2, "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = url_filter.rule_table(spark, url_filter.RULES)
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages, rules, ["page_id"]).collect()}
    assert url_filter.judge(pages, rules, ["page_id"]).count() == 2 * len(urls)
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("x.example.org", "/es/a", "example.org/es/", "block")
    assert got[5] == ("example.org", "", None, "allow")
    assert got[6] == ("b:", "//c/d", None, "allow")
    assert got[7] == ("badexample.org", "/es/", "org/", "allow")
    assert got[9][2:] == (None, "allow") and got[10][2:] == ("com/de/", "block")
    assert got[11] == ("Äb.com", "/fr/x\ny", "com/fr/", "allow")
    assert got[12][2:] == ("example.org/en/1", "block")
    assert url_filter.judge(pages.where("false"), rules, ["page_id"]).count() == 0
    assert url_filter.judge(pages, rules.where("false"), ["page_id"]).where("verdict = 'allow' AND rule IS NULL").count() == 2 * len(urls)


# ---- 10 -------------------------------------------------------------------------------------------------------------------------


def exact_weights(texts):
    """Weights from document frequencies that are counted text by text."""
    counts = np.zeros(near_dedup.SLOTS, dtype=np.int64)
    n = 0
    for t in texts:
        found, _, _ = words.Hashed([t]).counted(near_dedup.WIDTH)
        np.add.at(counts, (found % np.uint64(near_dedup.SLOTS)).astype(np.int64), 1)
        n += len(found) > 0
    return near_dedup.Weights(near_dedup.coded(counts), n).weighted(texts)


def test_near_dedup_equals_brute_force(spark, corpus):
    texts = [t for _, t in corpus]
    rnd = random.Random(1)
    for i in range(40):  # copies with a few edits, and one larger group
        own = words.words(texts[i % 5])[:300]
        for _ in range(rnd.randint(0, max(1, len(own) // 60))):
            own[rnd.randrange(len(own))] = f"edit{rnd.random()}"
        texts.append(" ".join(own))
    weights = exact_weights(texts)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs_of(spark, texts)).collect()}
    assert sorted(got) == list(range(len(texts)))
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if near_dedup.similarity(weights[i], weights[j]) >= near_dedup.SIMILARITY]
    missed = [p for p in alike if got[p[0]] != got[p[1]]]
    assert alike and len(missed) <= 0.01 * len(alike)
    linked = {i: i for i in range(len(texts))}  # no class joins what no chain of similar texts joins
    for i, j in alike:
        a, b = sorted((linked[i], linked[j]))
        linked = {k: a if v == b else v for k, v in linked.items()}
    assert all(linked[i] == linked[c] for i, c in got.items())


def test_document_frequencies_equal_brute_force(spark, corpus):
    texts = [t for _, t in corpus] * 3 + [None, "", "a b"]
    weights = near_dedup.fitted(docs_of(spark, texts).select("text").repartition(5), near_dedup.Scratch(spark, "test"))()
    for (a, w), (b, v) in zip(weights.weighted(texts), exact_weights(texts), strict=True):
        assert (a == b).all() and np.allclose(w, v)
    counts = np.zeros(1000, dtype=np.int64)
    counts[:900] = np.arange(900)
    sums = np.zeros(1000, dtype=np.int64)
    for _, _, at, n in [*near_dedup.emitted(counts, 0, 1, 0), *near_dedup.emitted(counts % 7 * (counts % 90 == 3), 0, 1, 0)]:
        if at:
            sums[np.frombuffer(at, dtype="<u4")] += np.frombuffer(n, dtype="<i8")
        else:
            sums += np.frombuffer(n, dtype=np.uint8)
    assert (sums == counts + counts % 7 * (counts % 90 == 3)).all()


def test_near_dedup_recall_in_a_template_family(spark):
    """Texts that share a template, alike to 0.7, in pairs that are alike to 0.8 and more: large buckets whose leaders join few."""
    rnd = random.Random(11)
    template = [f"t{i}" for i in range(650)]
    texts = []
    for i in range(700):
        own = [f"own{i}x{k}" for k in range(9)]
        for extra in range(2):
            texts.append(" ".join([*template, *own, *(f"last{i}x{extra}x{k}" for k in range(18))]))
    texts += [" ".join(f"far{i}x{k}" for k in range(150)) for i in range(100)]
    rnd.shuffle(texts)
    pairs = {}
    for i, t in enumerate(texts):
        pairs.setdefault(t.split()[650].split("x")[0] if t.startswith("t0 ") else f"far{i}", []).append(i)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs_of(spark, texts)).collect()}
    twins = [p for p in pairs.values() if len(p) == 2]
    assert len(twins) == 700
    weights = exact_weights(texts)
    alike = [(a, b) for a, b in twins if near_dedup.similarity(weights[a], weights[b]) >= 0.8]
    others = [near_dedup.similarity(weights[a[0]], weights[b[0]]) for a, b in zip(twins, twins[1:], strict=False)]
    assert len(alike) == 700 and 0.7 < min(others) and max(others) < 0.8
    missed = sum(got[a] != got[b] for a, b in alike)
    print("missed", missed, "of", len(alike))
    assert missed <= 0.01 * len(alike)
    assert len(set(got.values())) >= 800


def test_sampling_estimates_similarity():
    rnd = np.random.default_rng(4)
    n = near_dedup.BANDS * near_dedup.ROWS
    a = np.sort(rnd.choice(1 << 40, 400, replace=False)).astype(np.uint64)
    other = np.sort(np.concatenate([a[:300], rnd.choice(1 << 40, 100).astype(np.uint64)]))
    wa, wb = rnd.uniform(0.5, 4, 400), rnd.uniform(0.5, 4, 400)
    true = near_dedup.similarity((a, wa), (other, wb))
    near_rows = near_dedup.ROWS
    near_dedup.ROWS, keep = 1, near_rows
    old_bands, near_dedup.BANDS = near_dedup.BANDS, 16 * n
    try:
        s = near_dedup.Sampler(16 * n)
        keys = s.bands(np.concatenate([a, other]), np.repeat([0, 1], 400), np.concatenate([wa, wb]))
    finally:
        near_dedup.ROWS, near_dedup.BANDS = keep, old_bands
    assert abs((keys[0] == keys[1]).mean() - true) < 0.06


def test_near_dedup_odd_inputs(spark, empty):
    docs = docs_of(spark, ODD).withColumn("class_id", F.lit("clash")).withColumn("component", F.lit(0))
    more = docs.union(docs.where("doc_id = 6")).union(docs.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    got = [(r["doc_id"], r["class_id"]) for r in near_dedup.classes(more).collect()]
    assert sorted(got, key=str) == sorted([(i, i) for i in range(7)] + [(7, 6), (6, 6), (None, None)], key=str)
    assert near_dedup.classes(empty).count() == 0
    kept = near_dedup.keep_one(more)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([*range(7), None], key=str)


def test_hashed_words_equal_words(corpus):
    texts = [t for _, t in corpus[:80]] + [None, "", "É é, _x9 日本語!"]
    batch = words.Hashed(texts)
    for i, t in enumerate(texts):
        assert batch.begins[i + 1] - batch.begins[i] == len(words.words(t))
        assert (words.Hashed([t]).words == batch.words[batch.begins[i] : batch.begins[i + 1]]).all()
