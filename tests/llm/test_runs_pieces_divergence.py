"""Periodic runs, SentencePiece and source divergence: against brute force, the library and plain sums; nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from lumenframe.llm import divergence, periodic_runs, pieces, queries

MODEL = "piece_bpe_32k.model"
LONG = "word " * 30_000
ROWS = [(1, "a b c a b c a b c a b c x"), (1, "a b c a b c a b c a b c x"), (2, None), (3, ""), (4, " \n\t "), (None, "na " * 30), (5, LONG), (6, "A a " * 6), (7, "no period here"), (8, "x" * 5000), (9, "▁ <s> <0x41> \x00 é 😀")]


@pytest.fixture(scope="module")
def docs(spark):
    clash = {c: F.lit("own") for c in ("runs", "collapsed", "start", "length", "period", "ids", "agrees", "term", "n", "docs", "value", "rank", "item", "kept", "base", "digit")}
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns(clash)


def runs_by_hand(w, least=12):
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p) and not any(all(w[k] == w[k + q] for k in range(i, j + p - q)) for q in range(1, p)):
                out.append((i, j - i + p, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=4), st.integers(1, 14))
def test_runs_of_blocks(texts, least):
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    got = periodic_runs.find_runs(np.array([x for t in texts for x in t], np.uint64), bounds, least)
    for d, t in enumerate(texts):
        assert [(s - bounds[d], e - s, p) for s, e, p, of in got.T if of == d] == runs_by_hand(t, least)


def test_runs_of_long_texts():
    rng = random.Random(5)
    unit = [rng.randrange(1000) for _ in range(3000)]
    ones = np.zeros(200_000, np.uint64)
    assert periodic_runs.find_runs(ones, np.array([0, len(ones)])).T.tolist() == [[0, 200_000, 1, 0]]
    w = np.array([7, 8, 9, *unit * 5, 4], np.uint64)
    assert [3, 15_003, 3000, 0] in periodic_runs.find_runs(w, np.array([0, len(w)])).T.tolist()


def test_periodic_runs_query(spark, docs, sf_dir):
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120).collect()] + ROWS
    table = [(i, t) for i, t in table if t != LONG]
    small = spark.createDataFrame(table, "doc_id long, text string")
    got = Counter(tuple(r) for r in periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.with_planted_tails(small))).collect())
    want = Counter()
    for i, text in table:
        w = (text or "").encode().split()
        h = zlib.crc32(b"" if i is None else str(i).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        found = runs_by_hand(w)
        gone = {j for s, length, p in found for j in range(s + p, s + length)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
        sha = [hashlib.sha256(b).hexdigest() for b in ("".join(f"{s},{length},{p}\n" for s, length, p in found).encode(), b" ".join(x for j, x in enumerate(w) if j not in gone))]
        want[(i, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), *sha)] += 1
    assert got == want


def test_periodic_runs_of_odd_rows(docs):
    got = {r["doc_id"]: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 12, 3)] and got[1]["collapsed"] == "a b c x"
    assert [tuple(x) for x in got[None]["runs"]] == [(0, 30, 1)] and got[None]["collapsed"] == "na"
    assert [tuple(x) for x in got[5]["runs"]] == [(0, 30_000, 1)] and [tuple(x) for x in got[6]["runs"]] == [(0, 12, 2)]
    assert all(got[i]["runs"] == [] and got[i]["collapsed"] == "" for i in (2, 3, 4)) and got[8]["collapsed"] == "x" * 5000
    assert periodic_runs.periodic_runs(docs).count() == len(ROWS) and periodic_runs.digest(periodic_runs.periodic_runs(docs.limit(0))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" ▁\n\tabestonU.,<>0x1é́😀中ß\x00�-'") | st.characters(exclude_categories=["Cs"]), max_size=60), min_size=1, max_size=5))
def test_pieces_against_the_library(texts):
    m = pieces.piece_encoder(MODEL)
    ids, bounds = m.ids(pa.array(texts, pa.string()))
    want = m.library_model.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
    assert m.texts(ids, bounds).to_pylist() == m.library_model.decode(want)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300) | st.integers(0, 31_999), max_size=12), min_size=1, max_size=4))
def test_any_ids_decode_like_the_library(rows):
    m = pieces.piece_encoder(MODEL)
    got = m.texts(np.array([i for r in rows for i in r], np.int64), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    assert got.to_pylist() == [m.library_model.decode(r) for r in rows]


def test_pieces_query(spark, docs, sf_dir):
    sp = SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = sp.encode(r["text"] or "")
        want[(r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)), True)] += 1
    assert Counter(tuple(r) for r in queries.op12_sentencepiece(spark, sf_dir).collect()) == want
    coded = pieces.encode(docs, MODEL)
    back = pieces.decode(coded, MODEL)
    assert coded.where("agrees").count() == back.where("agrees").count() == len(ROWS)
    want = Counter((i, sp.decode(sp.encode(t or ""))) for i, t in ROWS)
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == want
    assert Counter((r["doc_id"], r["text"]) for r in pieces.round_trip(docs, MODEL).collect()) == want
    none = docs.limit(0)
    assert pieces.decode(pieces.encode(none, MODEL), MODEL).count() == pieces.digest(pieces.round_trip(none, MODEL)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 259])], "doc_id long, ids array<int>")
    assert sorted((r["doc_id"], r["text"], r["agrees"]) for r in pieces.decode(odd, MODEL).collect()) == [(1, "", True), (2, "", True), (3, " ", True)]


def audit_by_hand(rows, least_docs, top):
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(lower))
        n[lang, source].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang, source in groups:
        kept = [t for t, d in df[lang].items() if d >= least_docs]
        of = lambda s: n[lang, s] if s is not None else sum((n[g] for g in groups if g[0] == lang), Counter())  # noqa: B023, E731

        def shares(s):
            c = of(s)  # noqa: B023
            total = sum(c[t] for t in kept)  # noqa: B023
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}  # noqa: B023

        p = shares(source)
        found = {"pair": [], "term": []}
        for other in (s for of_lang, s in groups if of_lang == lang and s != source):
            q = shares(other)
            found["pair"].append((-sum((p[t] - q[t]) ** 2 // (p[t] + q[t]) for t in kept), other.encode(), other))
        q = shares(None)
        found["term"] = [(-((p[t] - q[t]) ** 2 // (p[t] + q[t])), t.encode(), t) for t in kept if n[lang, source][t] and p[t] > q[t]]
        for part, values in found.items():
            out |= {(lang, source, part, item, -v, i) for i, (v, _, item) in enumerate(sorted(values), 1) if part == "pair" or i <= top}
    return out


@pytest.mark.parametrize("ties", [1, 1000])
def test_audit(spark, monkeypatch, ties):
    monkeypatch.setattr(divergence, "TIES", ties)
    monkeypatch.setattr(divergence.top_rows, "__defaults__", (divergence.TOP, ties))
    rng = random.Random(7)
    vocabulary = ["the", "The", "Über", "über", "naïve", "中文", "a"] + [f"longprefix{c}{d}" for c in "abcdef" for d in "abcdefgh"]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randrange(40))), rng.choice(["en", "EN", None]), rng.choice(["s1", "s2", "s3", "é", None])) for _ in range(300)]
    rows += [(None, "en", "s1"), ("", "de", "only"), ("one two", "xx", "a"), ("one two", "xx", "b"), *[("each term once " * 3, "yy", s) for s in ("a", "a", "b", "b", "c")]]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit("own") for c in ("term", "n", "docs", "value", "rank", "item")})
    got = {tuple(r) for r in divergence.audit(docs, least_docs=4).collect()}
    assert got == audit_by_hand(rows, 4, 10)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_top_rows_by_bytes(spark):
    rng = random.Random(2)
    rows = [("l", "s", "".join(rng.choices("abé😀", k=rng.randrange(1, 6))) + f"x{i}", rng.choice([3, 2**29])) for i in range(200)] + [("l", "t", "only", 0), ("m", "s", "b", 2**30 - 1)]
    table = spark.createDataFrame(rows, "lang string, source string, term string, value long")
    for k, ties in ((1, 1), (10, 1), (10, 5), (150, 1), (500, 1000)):
        got = {(r["lang"], r["source"], r["term"], r["value"], r["rank"]) for r in divergence.top_rows(table, k, ties).collect()}
        want = set()
        for g in {r[:2] for r in rows}:
            own = sorted((r for r in rows if r[:2] == g), key=lambda r: (-r[3], r[2].encode()))
            want |= {(*r, i) for i, r in enumerate(own[:k], 1)}
        assert got == want
