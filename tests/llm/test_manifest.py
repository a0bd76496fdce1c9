import hashlib
import zlib

from attesta.llm import manifest as mf
from attesta.llm import queries as q


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        begin = at - at % 16
        out.append((level[begin:at], level[at + 1 : begin + 16]))
        at //= 16
    return out


def brute(rows):
    parts = {}
    for r in rows:
        parts.setdefault(r["source"], []).append(r)
    names = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        parts[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[s] = climb([leaf(r, r["text"]) for r in parts[s]])
    top = climb([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(parts[s]):
            steps = siblings(trees[s], i) + siblings(top, k)
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if c.isascii() else c for c in text)
            fold = leaf(r, text)
            for a, b in steps:
                fold = sha(*a, fold, *b)
            out.append((r["doc_id"], leaf(r, r["text"]), trees[s][-1][0], top[-1][0], sha(*[h for a, b in steps for h in a + b]), fold, fold == top[-1][0]))
    return sorted(out, key=str)


def query(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    got = q.op11_merkle_manifest(spark, str(folder))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def made(spark, sizes):
    rows = [(k * 7 % 100_003, f"Text {k}", "en", source, k) for source, n in sizes.items() for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_every_height_matches_brute_force(spark, tmp_path):
    docs = made(spark, {None: 1, "": 2, "a": 16, "b": 17, "é": 256, "z": 257, "Z": 5000} | {f"s{k}": 1 for k in range(20)})
    assert query(spark, docs, tmp_path) == brute([r.asDict() for r in docs.collect()])


def test_one_part_one_leaf(spark, tmp_path):
    for k, sizes in enumerate(({"a": 1}, {"a": 300}, {"a": 1, "b": 1})):
        docs = made(spark, sizes)
        assert query(spark, docs, tmp_path / str(k)) == brute([r.asDict() for r in docs.collect()])


def test_awkward_rows(spark, awkward, tmp_path):
    docs = awkward.withColumnRenamed("lang", "lang").selectExpr("*", "text AS hash", "1 AS part", "2 AS carry")
    assert query(spark, docs, tmp_path / "all") == brute([r.asDict() for r in docs.collect()])
    assert query(spark, awkward.limit(0), tmp_path / "none") == []


def test_wanted_proofs_and_stored_levels(spark):
    manifest = mf.build(mf.document_leaves(made(spark, {"a": 700, "b": 40})), ["doc_id"])
    levels = {r["tree"] + str(r["level"]): r["count"] for r in manifest.table().groupBy("tree", "level").count().collect()}
    assert levels == {"parts0": 740, "parts2": 4, "parts4": 2, "top0": 2, "top2": 1}  # levels 1 and 3 aren't kept
    wanted = spark.createDataFrame([("=a", 0), ("=a", 699), ("=b", 39), ("=c", 0), ("=b", 39)], "part string, idx long")
    found = mf.proofs(manifest, wanted).withColumn("to", mf.folded(mf.F.col("hash"))).collect()
    assert sorted((r.part, r.idx) for r in found) == [("=a", 0), ("=a", 699), ("=b", 39)] and {r.to for r in found} == {manifest.root}
