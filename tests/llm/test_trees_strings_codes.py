"""Merkle manifest, removal of repeated strings and vector codes against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import merkle, quantize, repeats

from .conftest import write_tables


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- Merkle manifest


def brute_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(digests):
    """(root, path of each leaf as (left, right) by level)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for leaf, i in enumerate(at):
            run = runs[i // 16]
            paths[leaf].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        at, level = [i // 16 for i in at], [sha("".join(r)) for r in runs]
    return level[0], paths


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text) to sorted (doc_id, leaf, subroot, root, proof, folded, verified)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
        trees[s] = brute_tree([brute_leaf(r) for r in by[s]])
    root, tops = brute_tree([trees[s][0] for s in names]) if names else (None, [])
    out = []
    for s, top in zip(names, tops, strict=True):
        for r, path in zip(by[s], trees[s][1], strict=True):
            path, claimed = path + top, r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                claimed = (*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]))
            folded = brute_leaf(claimed)
            for left, right in path:
                folded = sha(left + folded + right)
            out.append((r[0], brute_leaf(r), trees[s][0], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def made_manifest(spark, folder):
    return sorted((tuple(r) for r in merkle.op11(spark, folder).collect()), key=repr)


def test_manifest_matches_brute_force(spark, tmp_path, odd_docs):
    rng = random.Random(11)
    # sources of one leaf, of whole runs, of a last run of one, and one of more than a block
    sizes = {"a": 1, "b": 16, "c": 17, "d": 257, "É": 3, "": 2, None: 33, "hot": 4096 + 17}
    rows = [(rng.randrange(10**6), s, rng.choice(["en", None]), rng.choice([None, 5]), rng.choice([None, "", "Some TEXT É", "lower"])) for s, n in sizes.items() for _ in range(n)]
    rows += rows[:40]
    rng.shuffle(rows)
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    folder = write_tables(spark, tmp_path, documents=spark.createDataFrame(rows, schema).repartition(3))
    got = made_manifest(spark, folder)
    assert got == brute_manifest(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_manifest_of_odd_rows(spark, tmp_path, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select(*COLUMNS).collect()]
    assert made_manifest(spark, write_tables(spark, tmp_path / "odd", documents=odd_docs)) == brute_manifest(rows)
    assert made_manifest(spark, write_tables(spark, tmp_path / "none", documents=no_docs)) == []


def test_manifest_proves_any_fields(spark, odd_docs):
    done = merkle.manifest(spark, odd_docs, fields=("text", "lang"), by="lang", key="n_chars")
    assert done.columns == ["n_chars", "leaf", "claimed", "path", "subroot", "root"]
    held = done.select((merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok"), (merkle.fold(F.lit("0" * 64), F.col("path")) == F.col("root")).alias("no")).collect()
    assert len(held) == odd_docs.count() and all(r.ok and not r.no for r in held)


def test_traversal_returns_digest_and_appends_siblings():
    for n in (1, 2, 16, 17, 256, 4096):
        digests = [sha(str(i)) for i in range(n)]
        paths = [[] for _ in digests]
        root, brute = brute_tree(digests)
        assert merkle._traverse(digests, 0, n, merkle._levels(n), paths) == root
        assert [[(p["left"], p["right"]) for p in x] for x in paths] == brute


# --- repeated strings


def brute_kept(docs, length):
    """docs: distinct (doc_id, text_key, bytes) in order; (kept, removed, spans) of each."""
    seen, out = set(), []
    for _, _, data in docs:
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = True
            seen.add(window)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((bytes(b for b, g in zip(data, gone, strict=False) if not g), int(gone.sum()), spans))
    return out


def check_repeats(spark, df, length):
    keyed = df.select("doc_id", "text", repeats.tk.text_key().alias("key")).collect()
    order = sorted({(r.doc_id is not None, r.doc_id or 0, r.key, (r.text or "").encode()) for r in keyed})
    want = dict(zip([(x[0] and x[1], x[2]) for x in order], brute_kept([(x[1], x[2], x[3]) for x in order], length), strict=True))
    got = repeats.drop_repeats(spark, df.select("doc_id", "text"), length).withColumn("key", repeats.tk.text_key()).collect()
    assert len(got) == len(keyed)
    for r in got:
        assert (bytes(r.kept), r.n_removed, r.n_spans) == want[r.doc_id if r.doc_id is not None else False, r.key], r.doc_id
    return sum(r.n_removed for r in got)


def test_repeats_match_brute_force(spark):
    rng = random.Random(12)
    for letters, length in (("ab", 16), ("abcdefgh é", 24), ("abcdefghijklmnop", 100)):
        passages = ["".join(rng.choice(letters) for _ in range(rng.randint(10, 400))) for _ in range(6)]
        texts = []
        for i in range(50):
            parts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3)]
            cut = rng.choice(passages)
            texts.append((rng.randint(0, 45), parts[0] + cut[rng.randint(0, 9) : rng.randint(20, 400)] + parts[1] + rng.choice(passages) * rng.randint(0, 2) + parts[2] if i % 7 else rng.choice(["", None, "a" * 300, "ab" * 200, cut])))
        assert check_repeats(spark, spark.createDataFrame(texts + texts[:5], "doc_id bigint, text string").repartition(3), length) > 0


def test_repeats_of_common_passages_and_long_texts(spark):
    rng = random.Random(13)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    line, passage = word(70), word(300)
    # a line that is too short to go, in ever new company; passages that long texts share across their pieces
    texts = [(i, f"{word(40)}{line}{word(50)}{passage if i % 3 else passage[40:260]}{word(rng.randint(0, 90))}") for i in range(300)]
    long = word(repeats.PIECE - 150)
    texts += [(900, f"{long}{passage}{word(500)}"), (901, f"x{long}{passage}"), (902, " " * 5000), (903, "y" + " " * 700)]
    assert check_repeats(spark, spark.createDataFrame(texts, "doc_id bigint, text string"), 100) > repeats.PIECE


def test_repeats_of_odd_rows(spark, tmp_path, odd_docs, no_docs):
    assert check_repeats(spark, odd_docs, 100) == 0 and check_repeats(spark, odd_docs, 30) > 0
    done = repeats.drop_repeats(spark, odd_docs.withColumnRenamed("gone_id", "kept"), 100)
    assert done.columns == [*odd_docs.columns[:8], "kept", *odd_docs.columns[9:], "_kept", "n_removed", "n_spans"] and done.count() == odd_docs.count()
    assert repeats.op12(spark, write_tables(spark, tmp_path, documents=no_docs)).collect() == []
    with pytest.raises(ValueError):
        repeats.span_of(7)


def test_every_window_has_a_trigger_and_one_element():
    rng = np.random.default_rng(5)
    for letters in (1, 2, 26):
        sizes = [0, 99, 100, 101, 3000, 50, 700]
        data = rng.integers(97, 97 + letters, sum(sizes)).astype(np.uint8)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        got = [np.concatenate(x) for x in zip(*repeats.elements(data, bounds, 100), strict=True)]
        starts = sorted((int(r), int(a) + i) for r, a, n in zip(*got[:3], strict=True) for i in range(n))
        assert starts == [(r, p) for r, s in enumerate(sizes) for p in range(s - 99)]
        assert got[2].max() <= repeats.span_of(100)


# --- vector codes


def brute_codes(vectors, entries=256, rounds=4):
    """vectors: integer lists by kept (vec_id, ...) in order of the first entries; (codes, errors, codebooks)."""
    x = np.array(vectors, np.int64).reshape(len(vectors), 4, -1)
    books = [x[:entries, p].copy() for p in range(4)]
    for r in range(rounds + 1):
        square = [((x[:, p, None, :] - books[p][None]) ** 2).sum(axis=2) for p in range(4)]
        codes = np.stack([s.argmin(axis=1) for s in square], axis=1)
        if r < rounds:
            for p in range(4):
                for e in range(len(books[p])):
                    mine = x[codes[:, p] == e, p]
                    if len(mine):
                        books[p][e] = mine.sum(axis=0) // len(mine)
    return ["".join(f"{c:02x}" for c in row) for row in codes], [int(sum(square[p][i, codes[i, p]] for p in range(4))) for i in range(len(x))], books


def check_codes(spark, folder, rows):
    kept = [(i, label, [int(np.floor(1024 * np.float32(v))) for v in x]) for i, x, label in rows if x is not None and len(x) and all(v is not None and np.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    codes, errors, books = brute_codes([x for _, _, x in kept])
    names = sha_of(books)
    sums = {}
    for (_, label, _), e in zip(kept, errors, strict=True):
        sums[label] = sums.get(label, 0) + e
    want = sorted(((i, c, e, sums[label], names) for (i, label, _), c, e in zip(kept, codes, errors, strict=True)), key=repr)
    got = sorted((tuple(r) for r in quantize.op13(spark, folder).collect()), key=repr)
    assert got == want


def sha_of(books):
    return sha(",".join(str(v) for b in books for v in b.reshape(-1)))


VECTORS = "vec_id bigint, embedding array<float>, label int"


@pytest.mark.parametrize("seed, n, wide", [(1, 700, 0.02), (2, 400, 3.0), (3, 40, 1.0)])
def test_codes_match_brute_force(spark, tmp_path, seed, n, wide):
    """Narrow vectors have many equal distances; few vectors, fewer entries than 256."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, wide, (6, 8))
    rows = [(int(i), [float(v) for v in (centres[rng.integers(6)] + rng.normal(0, wide / 3, 8)).astype(np.float32)], int(rng.integers(3)) if rng.random() < 0.8 else None) for i in rng.permutation(n)]
    rows += [(5000, None, 1), (-1, [1.0, None] * 4, 1), (-2, [float("nan")] * 8, 2), (-3, [float("inf")] + [0.0] * 7, 2), (None, [0.5] * 8, None), rows[0], (rows[1][0], rows[2][1], 1)]
    check_codes(spark, write_tables(spark, tmp_path, embeddings=spark.createDataFrame(rows, VECTORS).repartition(3)), rows)


def test_codes_of_odd_tables(spark, tmp_path):
    none = spark.createDataFrame([], VECTORS)
    assert quantize.op13(spark, write_tables(spark, tmp_path / "a", embeddings=none)).collect() == []
    rows = [(1, [0.25] * 4, None), (2, [0.25] * 3, 1), (3, [], 1)]  # shorter ones lack components
    got = quantize.op13(spark, write_tables(spark, tmp_path / "b", embeddings=spark.createDataFrame(rows, VECTORS))).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in got] == [(1, "00000000", 0, 0)]
    with pytest.raises(ValueError):
        quantize.compress(spark, spark.createDataFrame([(1, [1.0] * 6, 1)], VECTORS))


def test_codes_restore_what_they_stand_for(spark):
    rows = [(i, [float(i % 5), 1.0, -2.0, i / 100], 0) for i in range(300)]
    codes, books = quantize.compress(spark, spark.createDataFrame(rows, VECTORS))
    for r in quantize.restore(codes, books).collect():
        off = sum((round(1024 * a) - round(1024 * b)) ** 2 for a, b in zip(r.vector, [np.floor(1024 * np.float32(v)) / 1024 for v in rows[r.vec_id][1]], strict=True))
        assert off == r.error


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    x = (rng.normal(0, 300, (6, 4))[rng.integers(6, size=900)] + rng.normal(0, 40, (900, 4))).astype(np.int64)
    entries = x[:64].copy()[None]
    books = quantize.Codebooks(entries, np.ones(1) / 16, np.zeros((1, 64)))
    code, upper, lower = quantize._first(books, 0, x)
    for _ in range(4):
        new = books.entries.copy()
        for e in range(64):
            if (code == e).any():
                new[0, e] = x[code == e].sum(axis=0) // (code == e).sum()
        moved = np.sqrt(((new - books.entries) ** 2).sum(axis=2))
        books = books._replace(entries=new, moved=moved)
        code, upper, lower, measured = quantize._again(books, 0, x, code, upper, lower)
        away = np.sqrt(((x[:, None, :] - new[0][None]) ** 2).sum(axis=2))
        assert (code == (away**2).round().astype(np.int64).argmin(axis=1)).all()
        assert (upper >= away[np.arange(900), code] - 1e-6).all() and (lower * books.unit[0] <= away + 1e-6).all()
        assert measured < 900 * 64 / 4
