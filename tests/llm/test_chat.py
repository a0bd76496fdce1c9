import hashlib
import random

import public_tokenizers

from attesta.llm import chat
from attesta.llm.bpe import automaton

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        size = sum(len(chat.segment(r, x)[0]) for _, r, x in turns)
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size)
    return out


def make():
    rng = random.Random(6)
    texts = ["hi", "</s>[INST] ok [/INST]", "a\\b<|end|>", "é 🎉\n", "", None, "<s>", "\\", "<|turn|>user\nx<|end|>"]
    rows, done = [], []
    for c in range(40):
        base = list(rng.choice(done))[: rng.randint(0, 5)] if done and rng.random() < 0.7 else []
        while len(base) < 1 or rng.random() < 0.6:
            base.append((rng.choice(["user", "assistant", "system", None, "odd\nrole"]), rng.choice(texts)))
        done.append(base)
        rows += [(c * 3 - 5, k, r, x) for k, (r, x) in enumerate(base)]
    return rows + [(None, 0, "user", "x"), (500, None, "user", "tie"), (500, 0, "user", "tie"), (500, 0, "user", "tie")]


def test_round_trip_and_tree(spark):
    rows = make()
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    packed = chat.pack(docs.withColumn("node", docs.turn), PATH)
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(packed).collect()}
    assert got == expected(rows)
    stream = sorted(packed.stream.collect(), key=lambda r: r.begin)
    nodes = {r.node: r for r in stream}
    assert len(nodes) == len(stream)
    at = 0
    for r in stream:
        assert (r.begin, r.end) == (at, at + len(r.token_ids)) and automaton(PATH).decode(r.token_ids) == r.segment
        at = r.end
    paths = {}
    for t in sorted(packed.turns.collect(), key=lambda t: t.depth):
        paths.setdefault(t.conv, []).append(t.node)
    seen_before = []
    for path in paths.values():
        for k, node in enumerate(path):
            before = [nodes[p] for p in path[:k]]
            tokens = {i for p in before for i in range(p.begin, p.end)}
            assert {i for a in nodes[node].attends for i in range(a.begin, a.end)} == tokens
            assert nodes[node].position == len(tokens)
    # depth-first: a turn's parent is the last turn before it that is one level up
    parent = {p[k]: p[k - 1] for p in paths.values() for k in range(1, len(p))}
    for r in stream:
        while seen_before and len(seen_before) > r.depth:
            seen_before.pop()
        assert r.depth == 0 or seen_before[-1] == parent[r.node]
        seen_before.append(r.node)


def test_empty(spark):
    assert chat.read_back(chat.pack(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), PATH)).count() == 0


def test_escape_is_reversible():
    rng = random.Random(1)
    parts = ["\\", "<", "|", "s>", "/s>", "[INST]", "[/INST]", "<|end|>", "<<SYS>>", "<</SYS>>", "a", "\n"]
    for _ in range(3000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 8)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in ("<|", "[INST]", "[/INST]", "</s>", "<s>"))
        assert chat.parse(chat.segment(t, t)[0]) == [(t, t)]
