"""Encoding, alignment and divergence against the libraries and plain versions."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riselens.llm import alignment, chunks, divergence, pieces
from riselens.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    None, "", " ", "  ", "a ", "  a", "a▁b", "▁ ▁", "\x00a", "a\nb", " \n \n", "a \n\n  b", "\r\n", "日本語 の　テキスト ", "　 　x", "a\xa0 b", "\xa0\n c \x1c d  e",
    "<s> </s> <unk> <0x41> <|endoftext|>x", "é", "�", "\U0001F600 a", "á b", "foo  bar é à la", "don't  we've I'll 12345 --", "x" * 5000, "ab " * 30000, "é" * 3000,
]


def frame(spark, texts, repeat=True):
    """Rows with columns whose names clash with the operators' own, a null and a repeated doc_id."""
    rows = [(k, t, ("en", "de", None)[k % 3], f"s{k % 2}", 1) for k, t in enumerate(texts)]
    if repeat:
        rows += [(None, "Two words.", "en", None, 1), (1, "One.", "xx", "s0", 1), (1, "One.", "xx", "s0", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("ids", "block", "pair", "n", "term", "prefix", "counts", "a_ids", "count", "total", "v", "p")})


def prose(seed, n=120):
    rng = random.Random(seed)
    letters = "aabcdeeéfghiiklmnoßöprsття日"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    marks = [" "] * 20 + ["  ", "\n", ", ", ". ", "\n\n ", "\t", "\xa0", "' "]
    return ["".join(w + rng.choice(marks) for w in rng.choices(words, k=rng.randint(1, 200))) for _ in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_round_trip_equals_library(spark, monkeypatch, small):
    """Also with a table that starts afresh all the time."""
    if small:
        monkeypatch.setattr(chunks, "MOST_CHUNKS", 50)
        monkeypatch.setattr(chunks, "LIMIT", 2000)
    texts = ODD + prose(1)
    model = pieces.Pieces(pieces.default_model())
    assert model.by_chunk
    for k in range(0, len(texts), 7):
        some = [t or "" for t in texts[k : k + 7]]
        ids, ends = model.encode(some)
        raw, at = model.decode(ids.astype(np.int64), ends)
        for j, t in enumerate(some):
            want = model.sp.encode(t)
            assert ids[ends[j] : ends[j + 1]].tolist() == want
            assert raw[at[j] : at[j + 1]].decode() == model.sp.decode(want)


def test_encode_and_decode_in_spark(spark, tmp_path):
    texts = ODD + prose(2, 40)
    sp = pieces.load(pieces.default_model()).sp
    docs = frame(spark, texts)
    rows = pieces.encode(docs).collect()
    assert len(rows) == len(texts) + 3
    by_id = {r.doc_id: r.ids for r in rows if r.doc_id not in (None, 1)}
    assert all(by_id[k] == sp.encode(t or "") for k, t in enumerate(texts) if k != 1)
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs)).collect() if r.doc_id not in (None, 1)}
    assert all(back[k] == sp.decode(sp.encode(t or "")) for k, t in enumerate(texts) if k != 1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op12_sentencepiece"](spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        if k != 1:
            ids = sp.encode(t or "")
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    assert pieces.round_trip(docs.limit(0)).collect() == []


def test_decode_of_any_ids(spark):
    sp = pieces.load(pieces.default_model()).sp
    rng = random.Random(3)
    lists = [[rng.randrange(0, 400) for _ in range(rng.randint(0, 12))] for _ in range(300)] + [None, [], [1, 264, 2], [0], [3 + 0xE2, 3 + 0x80], [259, 259]]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>").withColumn("text", F.lit("x"))
    assert {r.doc_id: r.text for r in pieces.decode(df).collect()} == {k: sp.decode(x or []) for k, x in enumerate(lists)}


def plain_alignment(model, text):
    """Ids of both, links and groups by comparing every byte range with its neighbours; nothing if the tokens do not spell the text."""
    if not text:
        return [], [], [], ""
    raw = (" " + text).encode()
    a, b = model.first.model.encode(" " + text, add_special_tokens=False).ids, model.second.sp.encode(text)
    spans = []
    for ids, names in ((a, model.first.bytes_of), (b, model.second.bytes_of)):
        if b"".join(names[i] for i in ids) != raw:
            return [], [], [], ""
        ends = np.cumsum([len(names[i]) for i in ids]).tolist()
        spans.append(list(zip([0, *ends[:-1]], ends)))
    owner = [None] * len(raw)
    for j, (s, e) in enumerate(spans[1]):
        owner[s:e] = [j] * (e - s)
    links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j in sorted(set(owner[s:e]))]
    cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, start = [], 0
    for cut in cuts:
        part = [",".join(str(i) for i, (s, e) in zip(ids, own) if start <= s and e <= cut) for ids, own in zip((a, b), spans)]
        groups.append("|".join(part))
        start = cut
    return a, b, links, ";".join(groups)


@pytest.mark.parametrize("lane", [512, 3])
def test_alignment_equals_plain_version(spark, monkeypatch, tmp_path, lane):
    monkeypatch.setattr(alignment, "LANE", lane)
    texts = [t[:600] if t else t for t in ODD + prose(4, 40)]
    model = alignment.load(*alignment._paths(None, None))
    want = [plain_alignment(model, t) for t in texts]
    x = model.align([t or "" for t in texts])
    groups = model.groups(x)
    for j, (a, b, links, text) in enumerate(want):
        assert x.a[x.a_at[j] : x.a_at[j + 1]].tolist() == a and x.b[x.b_at[j] : x.b_at[j + 1]].tolist() == b
        own = slice(x.link_at[j], x.link_at[j + 1])
        assert list(zip((x.link_a[own] - x.a_at[j]).tolist(), (x.link_b[own] - x.b_at[j]).tolist())) == links
        assert groups[j].decode() == text
    if lane != 3:
        return
    monkeypatch.setattr(alignment, "BLOCK", 3000)
    docs = frame(spark, texts, repeat=False)
    rows = {r.doc_id: r for r in alignment.align(docs).collect()}
    for j, (a, b, links, _) in enumerate(want):
        r = rows[j]
        assert (r.a_ids, r.b_ids, list(zip(r.link_a, r.link_b))) == (a, b, links)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    count, most = Counter(), {}
    for a, b, links, _ in want:
        count.update((a[i], b[j]) for i, j in links)
    for (_, j), n in count.items():
        most[j] = max(most.get(j, 0), n)
    got = {r.doc_id: r for r in QUERIES["op11_tokenizer_alignment"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for k, (a, b, links, text) in enumerate(want):
        ns = [count[a[i], b[j]] for i, j in links]
        best = sum(n == most[b[j]] for n, (_, j) in zip(ns, links))
        sha = hashlib.sha256(text.encode()).hexdigest() if text else ""
        r = got[k]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (len(a), len(b), text.count(";") + 1 if text else 0, len(links), best, sum(ns), sha)


def test_alignment_of_awkward_and_empty_tables(spark):
    docs = frame(spark, ODD)
    assert alignment.link_statistics(docs).count() == len(ODD) + 3
    assert alignment.link_statistics(docs.limit(0)).collect() == []
    assert alignment.align(docs.limit(0)).collect() == []


def divergence_sql(docs, least):
    documents = docs.select("doc_id", "text", "lang", "source").toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    return con.execute(divergence.ORACLE_SQL.replace(">= 30", f">= {least}")).df()


@pytest.mark.parametrize("least", [1, 3, 30, 10**6])
def test_divergence_equals_sql(spark, monkeypatch, least):
    """Thresholds that keep all terms, some or none; with small batches, small matrices and a filter full of false positives."""
    if least == 3:
        monkeypatch.setattr(divergence, "FILTER_BITS", 64)
        monkeypatch.setattr(divergence, "CELLS", 8)
    texts = [t and t[:2000] for t in ODD] + prose(5) + ["the THE The x" + "y" * 200 + "é"] * 3
    docs = frame(spark, texts)
    keys = ["lang", "source", "part", "rank"]
    got = divergence.source_divergence(docs, least).toPandas().sort_values(keys).reset_index(drop=True)
    want = divergence_sql(docs, least).sort_values(keys).reset_index(drop=True)
    assert len(got) and got.astype(str).equals(want[got.columns].astype(str))
    if least == 10**6:
        assert set(got["value"]) == {0} and set(got["part"]) == {"pair"}


def test_divergence_of_an_empty_table(spark):
    assert divergence.source_divergence(frame(spark, ["a"]).limit(0)).collect() == []
