"""Token ids, splitting and mixing."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Public

from palaver.llm import mixing, splitting, tokens

TOK = tokens.Tokenizer(open(tokens.VOCABULARY, "rb").read())
PUBLIC = Public.from_file("/opt/tokenizers/byte_bpe_50k.json")
PUBLIC.encode_special_tokens = True
HARD = [
    "", " ", "\n\n", "plain text, with 12 numbers.", "it's we'LL don't!!!'s", "a" * 3000, "中文分词" * 500, "🙂🏽‍💻" * 90, "\r\n \r\n\t x  ", "\x1c\x1d\x85\xa0 z", "<|endoftext|>", "naïve İstanbul ǅ ½ ²", "we'llama" * 50, "\0\x01\x7f\xad",
]


def public(text):
    return PUBLIC.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", HARD)
def test_ids_equal_the_public_tokenizer(text):
    assert TOK.encode(text) == public(text)
    assert TOK.decode(TOK.encode(text)) == text
    assert TOK.count(text) == len(TOK.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_of_any_text(text):
    assert TOK.encode(text) == public(text)
    assert TOK.decode(TOK.encode(text)) == text


def test_encode_corpus(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "hello hello"), (3, "hello hello"), (None, "x"), (4, "é" * 5000)], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = collections.Counter((r["doc_id"], tuple(r["ids"])) for r in tokens.encode_corpus(docs).collect())
    assert got == collections.Counter([(1, ()), (2, ()), (3, tuple(public("hello hello"))), (3, tuple(public("hello hello"))), (None, tuple(public("x"))), (4, tuple(public("é" * 5000)))])
    assert tokens.encode_corpus(docs.limit(0)).count() == 0
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in tokens.count_tokens(docs, "doc_id").collect()) == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2), (4, len(public("é" * 5000)))]


def check_split(text, limit, overlap):
    pieces = splitting.split_text(text, TOK, limit, overlap)
    assert "".join(text[new:end] for _, new, end, _, _ in pieces) == text
    for start, new, end, n, _ in pieces:
        assert n == len(public(text[start:end])) <= limit
    if len(public(text)) <= limit:
        assert len(pieces) == 1
    for (_, b, _, _, _), (start, new, _, _, shared) in zip(pieces, pieces[1:]):
        assert b <= start <= new and shared <= overlap
    return pieces


@pytest.mark.parametrize("text", HARD)
@pytest.mark.parametrize("limit,overlap", [(40, 0), (64, 16), (1200, 80)])
def test_split_hard_texts(text, limit, overlap):
    check_split(text * 7, limit, overlap)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab é中🙂'sl.,;!\n\r \t", max_size=400), st.sampled_from([(20, 0), (24, 6), (50, 30)]))
def test_split_any_text(text, size):
    check_split(text, *size)


def test_split_prefers_strong_boundaries():
    para = "Words go here and there. " * 12
    text = "\n\n".join([para.strip()] * 8)
    pieces = check_split(text, 200, 0)
    assert len(pieces) == 4 and all(text[:new].endswith("\n\n") for _, new, _, _, _ in pieces[1:])
    line = "one two three four five, six seven eight nine ten. " * 60
    assert all(line[:new].rstrip().endswith(".") for _, new, _, _, _ in check_split(line, 100, 10)[1:])


def test_split_overlap_is_exact_in_plain_text():
    text = "The quick brown fox jumps over the lazy dog and runs away again. " * 300
    assert {s for *_, s in check_split(text, 1200, 80)[1:]} == {80}


def test_split_rejects_a_useless_limit():
    with pytest.raises(ValueError):
        splitting.split_text("x", TOK, 90, 80)


def test_split_documents(spark):
    long = "word " * 5000
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (3, "short"), (4, long)], "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("piece", "n_tokens", "piece_no")})
    rows = splitting.split_documents(docs).collect()
    assert sorted((r["doc_id"], r["piece"], r["n_tokens"]) for r in rows if r["doc_id"] in (2, 3)) == [(2, "", 0), (3, "short", 1), (3, "short", 1)]
    assert [r["piece"] for r in rows if r["doc_id"] == 1] == [None]
    four = sorted((r["piece_no"], r["piece"], r["char_start"], r["char_new"]) for r in rows if r["doc_id"] == 4)
    assert "".join(p[new - start :] for _, p, start, new in four) == long
    assert splitting.split_documents(docs.limit(0)).count() == 0


def test_truncated_poisson_has_the_mean():
    for rate, cap in ((0.3, 3), (1.0, 1), (2.7, 3), (2.99, 3), (5.0, 40), (0.0, 2), (9.0, 4), (740, 1000), (760, 1000), (800, 1000), (999.5, 1000), (5000, 100_000), (5000, 5003), (123_456, 200_000)):
        base, cdf = mixing.truncated_cdf(rate, cap)
        assert base + sum(1 - c for c in cdf) == pytest.approx(min(rate, cap), rel=1e-9, abs=1e-6)
        assert base + len(cdf) <= cap and cdf == sorted(cdf)


def test_high_rates_give_poisson_counts():
    base, cdf = mixing.truncated_cdf(800, 5000)
    u = (np.arange(20_000) + 0.5) / 20_000
    n = base + np.searchsorted(cdf, u, "left")
    assert n.mean() == pytest.approx(800, abs=0.1) and n.var() == pytest.approx(800, rel=0.02)


DOCS = "doc_id bigint, source string, n_tokens bigint"
MIX = "source string, target_share double, max_repeats int"


def corpus(spark):
    rows = [(i, "big", 10) for i in range(4000)] + [(5000 + i, "small", 20) for i in range(300)] + [(6000 + i, "tiny", 5) for i in range(10)] + [(7000, None, 9), (7001, "unknown", 9), (7002, "big", 0)]
    rows += [(8000 + i, "void", 0) for i in range(20)]
    mix = [("void", 0.01, 4), ("big", 0.5, 3), ("small", 0.3, 4), ("tiny", 0.15, 3), ("absent", 0.05, 2), ("odd", None, None)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("rate", "copy_no", "cdf", "cap", "tokens")}), spark.createDataFrame(mix, MIX)


def test_plan_and_shares(spark):
    docs, mix = corpus(spark)
    plan = mixing.mix_plan(docs, mix)
    got = {r["source"]: r for r in plan.collect()}
    total = 4000 * 10 + 300 * 20 + 50
    assert got["big"]["total"] == total and got["big"]["rate"] == pytest.approx(0.5 * total / 40000)
    assert {s for s, r in got.items() if r["short"]} == {"tiny", "absent", "void"}
    assert {r["source"] for r in mixing.shares(mixing.replicate(docs, plan), plan).where("short").collect()} == {"tiny", "absent", "void"}
    copies = mixing.replicate(docs, plan)
    n = collections.Counter(r["doc_id"] for r in copies.collect())
    assert max(v for k, v in n.items() if 6000 <= k < 6010) == 3 and all(n[k] == 3 for k in range(6000, 6010))
    assert not n[7000] and not n[7001]
    share = {r["source"]: r for r in mixing.shares(copies, plan).collect()}
    want = 0.5 * total / (0.8 * total + 150)
    assert share["big"]["reached_share"] == pytest.approx(want, rel=0.05)
    assert sum(r["reached_share"] for r in share.values()) == pytest.approx(1)
    assert share["absent"]["mixed_tokens"] == 0


def test_order_and_draws_depend_on_seed_alone(spark):
    docs, mix = corpus(spark)
    plan = mixing.mix_plan(docs, mix)
    run = lambda df, seed: [(r["doc_id"], r["copy_no"]) for r in mixing.shuffled(mixing.replicate(df, plan, seed=seed), seed=seed).collect()]
    a = run(docs, 1)
    assert a == run(docs.repartition(9), 1) and a != run(docs, 2)
    assert np.corrcoef(range(len(a)), [d for d, _ in a])[0, 1] < 0.1
    salted = mixing.replicate(docs, plan, seed=1, max_sources=0).select("doc_id", "copy_no").collect()
    assert sorted(map(tuple, salted)) == sorted(a)


def test_mix_of_nothing(spark):
    docs, mix = corpus(spark)
    none = mixing.mix_plan(docs.limit(0), mix)
    assert none.where("short").count() == 0 and mixing.replicate(docs.limit(0), none).count() == 0
    assert mixing.mix_plan(docs, mix.limit(0)).count() == 0


def test_an_unbroken_run_is_cut_beside():
    prose = "word " * 300
    run = "".join(f"x{i:x}Q" for i in range(200))
    text = prose + run + " " + prose
    most = TOK.count(run) + 40
    pieces = splitting.split_text(text, TOK, max(most, 400), 40)
    assert all(n <= max(most, 400) for *_, n, _ in pieces)
    at = len(prose)
    assert not any(at + 1 < new < at + len(run) for _, new, *_ in pieces)
