import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attesta.llm import bpe
from attesta.llm import token_counts as tc
from attesta.llm.vocab import ByteVocab

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "the", " ", "  ", "\n", "\t", "é", "’", "'s", "'ll", "1", "２", "½", "²", "\xa0", "　", "\x85", "\x1c", "中文", "🎉", "́", "<|endoftext|>", "<|", "ß", "\r\n", "!!", "_", "ing", "tion", "​"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join) | st.text(max_size=30))
def test_encodes_and_decodes_as_the_library(text):
    lib = Tokenizer.from_file(PATH) if not hasattr(test_encodes_and_decodes_as_the_library, "lib") else test_encodes_and_decodes_as_the_library.lib
    test_encodes_and_decodes_as_the_library.lib = lib
    text = text.encode("utf-8", "ignore").decode()
    ids = lib.encode(text, add_special_tokens=False).ids
    a = bpe.automaton(PATH)
    assert a.encode(text) == ids and a.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_a_small_arc_table_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "ARCS", 8)
    monkeypatch.setattr(bpe, "LONG", 5)
    rng = random.Random(1)
    a = bpe.MergeAutomaton(PATH)
    texts = ["".join(rng.choices("abcdeinorst ", k=60)) for _ in range(300)]
    ids, begins = a.tokens(pa.array(texts))
    for t, lo, hi in zip(texts, begins[:-1], begins[1:]):
        assert ids[lo:hi].tolist() == library.encode(t, add_special_tokens=False).ids


def test_arcs_are_those_of_explicit_gadgets(tmp_path):
    """The first 200 merges, built by copying whole states, against the shared form; and the paths against merging by rank."""
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    by_id = {i: t for t, i in spec["model"]["vocab"].items()}
    merges = spec["model"]["merges"][:200]
    joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
    kept = {by_id[i]: i for i in by_id if len(by_id[i]) == 1 or by_id[i] in joined}
    spec["model"] |= {"vocab": kept, "merges": merges}
    spec["added_tokens"] = []
    small = tmp_path / "small.json"
    small.write_text(json.dumps(spec), encoding="utf-8")
    a, vocab = bpe.MergeAutomaton(str(small)), ByteVocab(str(small))
    first = [i for t, i in vocab.id_of.items() if len(t) == 1]
    states = {s: set(first) for s in [*first, -1]}
    for u, v, w in vocab.merges:
        split_off = set(states[v])
        states[u].discard(v)
        states[w] = split_off
        for arcs in states.values():
            if u in arcs:
                arcs.add(w)
    tokens = np.array(sorted(states.keys() - {-1}))
    for s in states:
        got = a._allowed(np.full(len(tokens), s), tokens)
        assert set(tokens[got].tolist()) == states[s]
    rank = {(u, v): (r, w) for r, (u, v, w) in enumerate(vocab.merges)}
    rng = random.Random(3)
    for _ in range(400):
        word = "".join(rng.choices("aehinorst ", k=rng.randint(1, 30))).encode()
        ids = [vocab.id_of[bytes([x])] for x in word]
        while True:
            best = min((rank[p] + (k,) for k, p in enumerate(zip(ids, ids[1:])) if p in rank), default=None)
            if best is None:
                break
            ids[best[2] : best[2] + 2] = [best[1]]
        assert a.spell(pa.array([word], pa.binary()))[0].tolist() == ids == a._long(word).tolist()


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in bpe.round_trip(docs, PATH).collect()}
    counts = {r.doc_id: r for r in tc.token_counts(docs, PATH, limit=1024, chunk=200, overlap=20).collect()}
    for d in docs.collect():
        ids = library.encode(d.text, add_special_tokens=False).ids
        r, c = rows[d.doc_id], counts[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(d.text.encode()).hexdigest())
        assert (c.n_bytes, c.n_tokens, c.over_limit) == (len(d.text.encode()), len(ids), len(ids) > 1024)


def test_spliced_counts_where_boundaries_are_rare(library):
    encode, lengths = tc.encoder(PATH)
    rng = random.Random(2)
    for _ in range(60):
        t = "".join(rng.choices(["x" * 40, " ", "\n\n", "é" * 30, "<|endoftext|>", "word", "\xa0", "  \t", "!?"], k=60))
        want = len(library.encode(t, add_special_tokens=False).ids)
        assert tc.count_spliced(t, encode, lengths, rng.randint(5, 60), rng.randint(1, 8)) == want


def test_chunks_stay_short_without_blanks(library):
    """Chinese without a blank, and a text with none of the stable boundaries."""
    encode, lengths = tc.encoder(PATH)
    rng = random.Random(4)
    text = "".join(rng.choice("的一是在不了有和人这中大为上个国我以要他") + ("。" if rng.random() < 0.05 else "") for _ in range(20_000))
    longest = 0

    def watched(t):
        nonlocal longest
        longest = max(longest, len(t))
        return encode(t)

    assert tc.count_spliced(text, watched, lengths, 1000, 100) == len(library.encode(text, add_special_tokens=False).ids) and longest < 2500
    bare = text.replace("。", "")
    assert tc.count_spliced(bare, encode, lengths, 1000, 100) == len(library.encode(bare, add_special_tokens=False).ids)


def test_awkward_rows(spark, awkward):
    clash = awkward.withColumn("_ids", awkward.doc_id)
    out = bpe.decode(bpe.encode(clash, PATH), PATH)
    assert out.count() == awkward.count() and all((r.text or "") == r.decoded for r in out.collect())
    assert tc.token_counts(awkward, PATH).count() == awkward.count()
    assert bpe.encode(awkward.limit(0), PATH).count() == 0 and tc.token_counts(awkward.limit(0), PATH).count() == 0


def test_long_runs_of_white_space(spark, library):
    n = 2_000_000
    texts = [" " * n, "\n" * n, "a" + "\t" * n + "b", "a" + " " * n + "<|endoftext|>" + "\n" * n, "\xa0 " * 5000 + "word" + " \n" * 5000 + "!", "x" + " " * 4095 + "y" + " " * 4096 + "z" + " " * 4097, "\u3000" * 5000 + "\x1c" + " " * 5000 + "\x1c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tc.token_counts(docs, PATH).collect()}
    assert got == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
