import hashlib
import json
import random
import struct
import sys
import zlib

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontaminate, langid, licenses, media, toxicity
from graphloom.llm import textkit as tk

from ..conftest import rows
from .conftest import LONG, PHRASE, write_tables

WORD = licenses._WORD
LOW = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOW))


# the text kit
def test_word_spans_and_hashes_match_a_regex():
    import pyarrow as pa

    texts = ["The É1 b-c", "", None, "x" * 50, "9 a\x00b一 Z", "a b"]
    for limit in (1, 20, 1 << 20):
        got, hashes = [], {}
        for lo, hi, raw, bounds in tk.text_chunks(pa.array(texts), limit):
            data = tk.LOWER[raw]
            starts, ends, first = tk.word_spans(data, bounds, tk.ALNUM)
            h = tk.span_hashes(data, starts, ends)
            for r in range(hi - lo):
                got.append([bytes(data[s:e]).decode() for s, e in zip(starts[first[r] : first[r + 1]], ends[first[r] : first[r + 1]], strict=True)])
                for w, x in zip(got[-1], h[first[r] : first[r + 1]], strict=True):
                    assert hashes.setdefault(w, x) == x
        assert got == [words(t) for t in texts]
        assert len(set(hashes.values())) == len(hashes)


# 1: decontamination
def brute_hits(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        v = words(t)
        m = min(len(v), 10)
        if not m:
            continue
        windows = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)}
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                found.add(item)
    return len(w), len(hit), sorted(str(x) for x in found if x is not None)


def test_decontamination_matches_brute_force(spark, odd_docs, items, no_docs):
    rng = random.Random(3)
    some = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    bench = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 24)))) for i in range(25)]
    docs = spark.createDataFrame(some, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontaminate.decontaminate(spark, docs, spark.createDataFrame(bench, "item_id bigint, text string")).collect()}
    assert got == {i: brute_hits(t, bench) for i, t in some}
    pairs = [(r.item_id, r.text) for r in items.collect()]
    odd = decontaminate.decontaminate(spark, odd_docs, items).collect()
    distinct = {(r.doc_id, r.text) for r in odd_docs.collect()}
    assert len(odd) == len(distinct)
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.item_ids) for r in odd) == sorted((i or 0, *brute_hits(t, pairs)) for i, t in distinct)
    assert decontaminate.decontaminate(spark, no_docs, items).count() == 0
    clean = decontaminate.decontaminate(spark, odd_docs, items.where("false"))
    assert clean.where("n_hit > 0").count() == 0


def test_contaminated_rows_go(spark, odd_docs, items):
    left = decontaminate.drop_contaminated(spark, odd_docs, items.where("item_id = 1"))
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count() - 1
    assert not any(r.text and PHRASE.upper() in r.text for r in left.collect())


# 2: media
def test_signatures():
    chunk = lambda k, x: struct.pack(">I", len(x)) + k + x + struct.pack(">I", zlib.crc32(k + x))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", b"GIF89a") + chunk(b"IEND", b"")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + bytes(9) + b"\x02\x01\x00\x00" + b"\x3b"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x05xyz\xff\xda\x00\x02ab\xff\x00c\xff\xd9"
    bmp = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + bytes(40)
    gz = zlib.compressobj(9, zlib.DEFLATED, 31)
    gz = gz.compress(b"hello") + gz.flush()
    ogg = b"OggS\0\x04" + bytes(20) + b"\x01\x03abc"
    pdf = b"%PDF-1.4 startxref 5 %%EOF"
    for kind, b in (("image/png", png), ("image/gif", gif), ("image/jpeg", jpeg), ("image/bmp", bmp), ("application/gzip", gz), ("audio/ogg", ogg), ("application/pdf", pdf), ("audio/wav", media.store(b"ab"))):
        assert media.carve(b"--" + b + b"--") == [media.Found(kind, 2, 2 + len(b))], kind
        assert media.sniff(b + b"tail") == kind
        assert media.carve(b[:-1]) == [] or kind == "application/pdf", kind
    assert media.sniff(b"BM in plain text") == "application/octet-stream" and media.sniff(None) is None
    broken = png.replace(b"IDAT", b"IDAX")
    assert media.signatures(broken) == []
    payload = media.pad(b"q" + png + b"BM")
    assert media.load(media.store(payload)) == (1, 8000, 8, payload, [media.Found("image/png", 1, 1 + len(png))])
    with pytest.raises(ValueError):
        media.load(b"RIFF")


def test_store_and_read_back(spark, odd_docs, no_docs, tmp_path):
    d = write_tables(spark, tmp_path, documents=odd_docs)
    want = []
    for r in odd_docs.collect():
        raw = (r.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.append((r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    got = media.op2(spark, d).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    assert rows(got) == sorted(want, key=repr)
    typed = media.correct_types(media.store_texts(odd_docs)).collect()
    assert {(r.media_type, r.corrected) for r in typed} == {("audio/wav", True)}
    assert media.correct_types(spark.createDataFrame([(None, "image/png", 1)], "media binary, declared string, kind int")).first().media_type is None
    assert media.op2(spark, write_tables(spark, tmp_path / "e", documents=no_docs)).count() == 0


# 3: toxicity
def brute_segments(scores):
    """Maximal-scoring segments by their definition: split at the best one."""
    if not any(s > 0 for s in scores):
        return []
    best, at = 0, None
    for i in range(len(scores)):
        total = 0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-9:
                best, at = total, (i, j + 1)
    a, b = at
    return brute_segments(scores[:a]) + [(a, b)] + [(x + b, y + b) for x, y in brute_segments(scores[b:])]


def test_segments_match_the_definition():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 25)
        at = sorted(rng.sample(range(n), rng.randint(0, n)))
        scores = [rng.choice([0.53, 1.07, 2.31]) for _ in at]
        full = [-0.411] * n
        for i, s in zip(at, scores, strict=True):
            full[i] = s
        got = toxicity.segments(np.array(at, int), np.array(scores), 0.411)
        assert [(a, b) for a, b, _ in got] == brute_segments(full)


def test_toxicity_learns_words(spark, odd_docs, no_docs, tmp_path):
    rng = random.Random(5)
    plain, bad = [f"word{i}" for i in range(300)], ["vile", "awful", "rotten"]
    docs, labels = [], []
    for i in range(400):
        text = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        docs.append((1000 + i, " ".join(text)))
        labels.append((1000 + i, int(toxic)))
    table = spark.createDataFrame(docs, "doc_id bigint, text string").unionByName(odd_docs.select("doc_id", "text"))
    marks = spark.createDataFrame([*labels, (None, 1), (1, None), (3, 0)], "doc_id bigint, toxic int")
    d = write_tables(spark, tmp_path, documents=table, labels=marks)
    got = toxicity.op3(spark, d).collect()
    assert len(got) == table.count()
    truth = dict(labels)
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert len(held) > 40 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1
    none = toxicity.op3(spark, write_tables(spark, tmp_path / "n", documents=table, labels=marks.where("false"))).collect()
    assert {r.predicted for r in none} == {0}
    assert toxicity.op3(spark, write_tables(spark, tmp_path / "e", documents=no_docs, labels=marks)).count() == 0


# 4: licenses
def test_license_phrases_match_brute_force(spark, odd_docs, no_docs, tmp_path):
    rng = random.Random(6)
    vocabulary = "under the mit license apache version 2 cc by nc".split()
    some = [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 400)))) for i in range(80)]
    some += [(300, "Under THE MIT\nLicense; under the mit license. Apache License, Version 2"), (301, "CC BY-NC cc-by-nc cc by nc")]
    table = spark.createDataFrame(some, "doc_id bigint, text string").unionByName(odd_docs.select("doc_id", "text"))
    got = licenses.op4(spark, write_tables(spark, tmp_path, documents=table)).collect()
    distinct = {(r.doc_id, r.text) for r in table.collect()}
    assert len(got) == len(distinct)
    assert sorted(((r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=repr) == sorted(((i or 0, *licenses.brute_base(t)) for i, t in distinct), key=repr)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in got)
    assert licenses.op4(spark, write_tables(spark, tmp_path / "e", documents=no_docs)).count() == 0


def test_license_templates_bear_small_changes(spark, tmp_path):
    text = "this work was long ago licensed under the gnu general public license version 3"
    bsd = "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are all met"
    docs = spark.createDataFrame([(1, text), (2, bsd), (3, "forms with or without")], "doc_id bigint, text string")
    got = {r.doc_id: r.labels for r in licenses.op4(spark, write_tables(spark, tmp_path, documents=docs)).collect()}
    assert got == {1: "gpl-3", 2: "bsd", 3: ""}


# 5: BPE
@pytest.fixture(scope="module")
def pair():
    path = bpe.default_path()
    return bpe.tokenizer(path), tokenizers.Tokenizer.from_file(path)


def test_automaton_accepts_only_what_the_merges_make():
    a = bpe.Automaton(["a", "b", "c"], [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "a"), ("aa", "aa")])

    def merged(word):
        parts = list(word)
        for u, v in [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "a"), ("aa", "aa")]:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (u, v):
                    parts[i : i + 2] = [u + v]
                i += 1
        return parts

    import itertools

    for n in range(1, 8):
        for word in itertools.product("abc", repeat=n):
            assert a.decode(a.encode("".join(word))) == merged(word)
    assert not a.follows(a.ids["a"], a.ids["b"]) and a.follows(a.ids["ab"], a.ids["a"])


def test_same_as_the_library(pair):
    mine, theirs = pair
    rng = random.Random(7)
    letters = "aaabbcdeeffgghiijkllmnnooprsstttuuvwxyz''’ ÉéßΣσİẞ漢字あ١٢½🎉\t\n\x85\xa0　\x1c​́!?..,,--0123"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) + rng.choice(["", "", "<|endoftext|>x", "it's We'RE", "a" * 11, "Word.", "Élan,"])
        ids = mine.encode(text)
        assert ids == theirs.encode(text, add_special_tokens=False).ids, text
        assert mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False) == mine.texts(text)[1]


def test_tokenize_odd_texts(spark, odd_docs, no_docs, pair):
    got = {(r.doc_id, r.ids_sha256, r.n_tokens, r.decoded_sha256, tuple(r.input_ids)) for r in bpe.tokenize(odd_docs).collect()}
    want = set()
    for r in odd_docs.collect():
        ids = pair[1].encode(r.text or "", add_special_tokens=False).ids
        text = pair[1].decode(ids, skip_special_tokens=False)
        want.add((r.doc_id, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), len(ids), hashlib.sha256(text.encode()).hexdigest(), tuple(ids)))
    assert got == want and bpe.tokenize(odd_docs).count() == odd_docs.count() and bpe.tokenize(no_docs).count() == 0


# 9: language
def test_language(spark, odd_docs, no_docs, tmp_path):
    rng = random.Random(8)
    alphabets = {"xx": "abcdeftg", "yy": "uvwxyzaé", "zz": "漢字語文章学"}
    docs = []
    for i in range(360):
        lang = "xyz"[i % 3] * 2
        docs.append((1000 + i, " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(3, 60))), lang if i % 7 else None, lang))
    truth = {i: lang for i, _, _, lang in docs}
    table = spark.createDataFrame([d[:3] for d in docs], "doc_id bigint, text string, lang string").unionByName(odd_docs.where("doc_id IN (3, 4, 5, 8)").select("doc_id", "text", "lang"))
    got = langid.op9(spark, write_tables(spark, tmp_path, documents=table)).collect()
    assert len(got) == table.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert {(r.doc_id, r.lang_pred) for r in got if r.doc_id in (3, 4, 5, 8)} == {(i, "und") for i in (3, 4, 5, 8)}
    nobody = langid.op9(spark, write_tables(spark, tmp_path / "n", documents=table.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")))
    assert {r.lang_pred for r in nobody.collect()} == {"und"}
    assert langid.op9(spark, write_tables(spark, tmp_path / "e", documents=no_docs)).count() == 0


def test_rows_without_language_go(spark, odd_docs):
    left = langid.drop_unknown(spark, odd_docs, min_score=0.0)
    assert left.columns == odd_docs.columns
    assert rows(left.select("doc_id", "text")) == rows(odd_docs.where("text RLIKE '[A-Za-z]' OR doc_id = 10").select("doc_id", "text"))


def test_without_any_language_texts_with_letters_stay(spark, odd_docs):
    bare = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    left = langid.drop_unknown(spark, bare)
    assert left.columns == bare.columns and left.count() == bare.where(F.col("text").rlike(r"\p{L}")).count() > 5


def test_counts_cover_whole_texts():
    at, n = langid.gram_counts(LONG)
    assert n.sum() == 3 * len(LONG) - 3 and langid.gram_counts("")[0].size == 0


def test_compiled_arcs_are_those_of_the_states(pair):
    """Whether an arc is there, read off the gadgets, against the states' own records."""
    a, rng = pair[0].automaton, random.Random(13)
    n = len(a.labels)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(3000)] + [(a.left[m], a.right[m]) for m in rng.sample(range(n), 2000) if a.made[m] >= 0] + [(-1, rng.randrange(n)) for _ in range(50)]
    x, y = (np.array(v) for v in zip(*pairs, strict=True))
    want = [a.leaves(a.state[p] if p >= 0 else 0, q) for p, q in pairs]
    assert a.arcs(x, y).tolist() == want and a.arcs(x, y).tolist() == want and 1000 < sum(want) < 4000


def test_batches_forget_nothing_that_matters(pair, monkeypatch):
    """Words that are long, that repeat, and that no longer fit the tables get the same tokens."""
    mine, theirs = pair
    rng = random.Random(14)
    texts = [" ".join("".join(rng.choice("abcdeénou") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["ab" * 3000, "x" * 200 + " y", "", "Σσ ΑΣ"]
    monkeypatch.setattr(mine, "cache_words", 40)
    mine.forget()
    for lo in range(0, len(texts), 7):
        for text, (ids, decoded) in zip(texts[lo : lo + 7], mine.batch(texts[lo : lo + 7]), strict=True):
            want = theirs.encode(text, add_special_tokens=False).ids
            assert ids == " ".join(map(str, want)) and decoded == theirs.decode(want, skip_special_tokens=False)


def test_words_take_their_steps_in_bounded_numbers(pair, monkeypatch):
    mine, theirs = pair
    seen, encode = [], mine.automaton.encode_words
    monkeypatch.setattr(bpe, "STEP_LETTERS", 50, raising=False)
    monkeypatch.setattr(mine.automaton, "encode_words", lambda codes, bounds: seen.append(len(codes)) or encode(codes, bounds))
    mine.forget()
    text = " ".join([f"w{chr(97 + i % 26)}{chr(97 + i // 26)}ab" for i in range(200)] + ["long" * 30])
    want = theirs.encode(text, add_special_tokens=False).ids
    assert mine.texts(text)[0] == " ".join(map(str, want))
    assert len(seen) > 10 and sorted(seen)[-2] <= 50


def test_words_take_few_calls(pair):
    """Texts are split and put together by columns, so that Python makes no calls for words that are known, and few for new ones."""
    mine, theirs = pair
    mine.forget()
    texts = [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}ab," for i in range(lo, lo + 4000)) for lo in (0, 1000, 0)]
    want = [" ".join(map(str, theirs.encode(t, add_special_tokens=False).ids)) for t in texts]
    calls = []
    for part, held in ((texts[:2], want[:2]), (texts[2:] * 3, want[2:] * 3)):
        seen = []
        sys.setprofile(lambda frame, event, arg, seen=seen: seen.append(event) if event in ("call", "c_call") else None)
        try:
            got = list(mine.batch(part))
        finally:
            sys.setprofile(None)
        assert [x for x, _ in got] == held
        calls.append(len(seen))
    assert calls[0] < 4 * 5000 and calls[1] < 200


def test_special_tokens_with_spaces(pair, tmp_path):
    """A special token is found before texts are split, and is no word of the same letters."""
    with open(bpe.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"] += [{"id": 49408 + i, "content": x, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for i, x in enumerate(["<a b>", "abcq"])]
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    mine, theirs = bpe.Tokenizer(str(path)), tokenizers.Tokenizer.from_file(str(path))
    for text in ("x<a b>y <a  b> ABCQ abcq xabcqx\n<a\nb> Abcq", "<a b>", " abcq ", "<|endoftext|><a b><|ENDOFTEXT|>"):
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids and mine.texts(text)[1] == theirs.decode(ids, skip_special_tokens=False)


def test_the_query_matches_the_library(spark, odd_docs, pair, tmp_path):
    got = bpe.op5(spark, write_tables(spark, tmp_path, documents=odd_docs))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for r in odd_docs.collect():
        ids = pair[1].encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(pair[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows(got) == sorted(want, key=repr)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: pair[1].encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in bpe.op5(spark, "/root/testdata/sf0.001").collect()} == {i: len(x) for i, x in texts.items()}


def test_words_of_one_structure_have_other_hashes():
    """Thue-Morse words and their complements, which collide in every polynomial hash modulo a power of two."""
    word = "a"
    while len(word) < 4096:
        word += word.translate({97: 98, 98: 97})
    for n in (64, 1024, 4096):
        data = np.frombuffer((word[:n] + " " + word[:n].translate({97: 98, 98: 97})).encode(), np.uint8)
        for seed in (0, 1):
            a, b = tk.span_hashes(data, np.array([0, n + 1]), np.array([n, 2 * n + 1]), seed)
            assert a != b
    data = np.frombuffer(b"same same", np.uint8)
    h = [tk.span_hashes(data, np.array([0, 5]), np.array([4, 9]), seed) for seed in (0, 1)]
    assert h[0][0] == h[0][1] and h[1][0] == h[1][1] and h[0][0] != h[1][0]


def brute_toxicity(docs, labels):
    """Scores of docs (id -> text) learned from labels (id -> 0 or 1): counts, odds, segments and calibration word by word. Its texts have no near copies, only exact ones."""
    t = toxicity

    def tokens(w):
        b = w.encode()
        return [w, ("stem", b[: t.STEM])] if len(b) > t.STEM else [w]

    held = {i: {x for w in words(text) for x in tokens(w)} for i, text in docs.items()}
    once = {}
    for i in sorted(labels):
        if i in docs:
            once.setdefault((tuple(words(docs[i])), labels[i]), i)
    toxic, clean = ([i for (_, v), i in once.items() if v == k] for k in (1, 0))
    count = lambda ids, x: sum(x in held[i] for i in ids)
    lexicon = {}
    for x in set().union(*[held[i] for i in toxic]):
        a, b, n = count(toxic, x), count(clean, x), count(docs, x)
        alpha = t.PRIOR_FLOOR + t.PRIOR_MASS * n / (len(docs) * 100)
        odds = np.log((a + alpha) / (len(toxic) + alpha * 2 - a)) - np.log((b + alpha) / (len(clean) + alpha * 2 - b))
        if a >= t.MIN_DOCS and odds >= t.MIN_ODDS and odds / np.sqrt(1 / (a + alpha) + 1 / (b + alpha)) >= t.MIN_Z:
            lexicon[x] = (odds, a, b)
    penalty = min(0.5, max(0.02, sum(a for _, a, _ in lexicon.values()) / len(toxic) / 100))
    lam = t.extreme_value_rate(np.array([round(o, 2) for o, _, _ in lexicon.values()]), np.array([(b + 0.5) / (len(clean) * 100) for _, _, b in lexicon.values()]), penalty)

    def measure(text):
        w = words(text)
        scores = [max([lexicon[x][0] for x in tokens(v) if x in lexicon], default=-penalty) for v in w]
        total = [sum(scores[a:b]) for a, b in brute_segments(scores)]
        return -np.log(max(len(w), 1)) + (np.logaddexp.reduce([lam * s for s in total]) if total else 0)

    x = np.array([round(measure(docs[i]) / t.BIN) * t.BIN for i in once.values()])
    y = np.array([v for _, v in once], float)
    slope, offset = t._logistic(x, y, 1 - y)
    return {i: 1 / (1 + np.exp(-(slope * measure(text) + offset))) for i, text in docs.items()}


def test_toxicity_matches_brute_force(spark, tmp_path):
    rng = random.Random(15)
    plain, bad = [f"wor{'xyz'[i % 3]}d{i}" for i in range(60)], ["vileness", "vilest", "awful", "rot"]
    docs, labels = {}, {}
    for i in range(160):
        text = [rng.choice(plain) for _ in range(rng.randint(0, 40))]
        if i % 3 == 0:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randint(0, len(text)), rng.choice(bad))
        docs[i] = " ".join(text)
        if i < 130:
            labels[i] = int(i % 3 == 0) if rng.random() < 0.95 else 1
    docs[200] = docs[201] = docs[3]
    labels |= {200: 1, 201: 0}
    d = write_tables(spark, tmp_path, documents=spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id bigint, text string, toxic string"), labels=spark.createDataFrame([(i, v, "y") for i, v in labels.items()], "doc_id bigint, toxic int, text string"))
    used = {i: v for i, v in labels.items() if zlib.crc32(str(i).encode()) % 5}
    want = brute_toxicity(docs, used)
    got = {r.doc_id: r.score for r in toxicity.op3(spark, d).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-6
    assert len({round(x, 3) for x in want.values()}) > 10


def test_texts_that_share_one_passage_are_no_copies():
    import pyarrow as pa

    rng = random.Random(16)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(60)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(62)), "text": [*texts, texts[0], texts[0].upper()]})
    keys = [k for b in toxicity._copy_keys(iter([batch])) for k in b.column("near").to_pylist()]
    assert len(set(keys[:60])) == 60 and keys[60] == keys[61] == keys[0]


def test_feature_and_form_of_stored_texts(spark, odd_docs, tmp_path):
    """media_sha256 and feature, recomputed from the format's definition; equal texts have equal values."""
    import io
    import wave

    got = media.op2(spark, write_tables(spark, tmp_path, documents=odd_docs)).collect()
    texts = {}
    for r in got:
        texts.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.feature, r.media_bytes))
    assert all(len(x) == 1 for x in texts.values())
    for r in odd_docs.collect():
        raw = (r.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000), w.writeframes(payload)
        signs = [x >= 128 for x in payload]
        want = f"audio/wav;channels=1;rate=8000;bits=8;peak={max(abs(x - 128) for x in payload)};crossings={sum(a != b for a, b in zip(signs, signs[1:]))}"
        assert texts[hashlib.sha256(payload).hexdigest()] == {(hashlib.sha256(out.getvalue()).hexdigest(), want, len(out.getvalue()))}


def test_declared_types_are_corrected(spark):
    wav, gz = media.store(b"ab"), zlib.compress(b"x" * 5, wbits=31)
    rows_ = [(1, wav, "audio/wav"), (2, wav, "image/png"), (3, b"plain", "image/gif"), (4, b"plain", "application/octet-stream"), (5, None, "x"), (6, gz + b"--" + gz, None)]
    got = {r.key: (r.media_type, r.corrected, len(r.carved)) for r in media.correct_types(spark.createDataFrame(rows_, "key int, media binary, declared string")).collect()}
    assert got == {1: ("audio/wav", False, 0), 2: ("audio/wav", True, 0), 3: ("application/octet-stream", True, 0), 4: ("application/octet-stream", False, 0), 5: (None, False, 0), 6: ("application/gzip", True, 1)}
    back = media.read_back(spark.createDataFrame(rows_, "key int, media binary, declared string")).where("payload IS NOT NULL").collect()
    assert {(r.key, bytes(r.payload), r.rate) for r in back} == {(1, b"ab", 8000), (2, b"ab", 8000)}
    clash = media.inspect(spark.createDataFrame([(wav, "audio/wav", 7)], "media binary, declared string, RATE int"))
    assert clash.columns[:3] == ["media", "declared", "RATE"] and (clash.first().RATE, clash.first()._rate, clash.first().corrected) == (7, 8000, False)


def test_many_signatures_take_linear_time():
    import time

    def seconds(data):
        began = time.perf_counter()
        media.signatures(data)
        return time.perf_counter() - began

    end = b"PK\x05\x06" + bytes(18)
    bomb = zlib.compressobj(9, zlib.DEFLATED, 31)
    bomb = b"".join([bomb.compress(bytes(1 << 20)) for _ in range(200)]) + bomb.flush()
    assert media.carve(b"-" + bomb) == [media.Found("application/gzip", 1, 1 + len(bomb))]
    for text in (b"PK\x03\x04" * 200_000, end * 20_000 + b"PK\x03\x04" * 50_000, b"%PDF-" * 200_000 + b"%%EOF", b"%PDF-%%EOF" * 50_000):
        assert seconds(text) < 5
    # chains of pages, blocks and chunks that each of many objects leads into; the last two end well
    page = b"OggS\0" + bytes(22)
    gif = b"GIF89a" + bytes(6)
    chains = {
        "ogg": lambda n: page * (n // 27),
        "gif": lambda n: gif + b"\0" + b"\x21\0" + (bytes([13]) + gif + b"\0") * (n // 14),
        "jpeg": lambda n: b"\xff\xd8\xff\xe0\0\x02" * (n // 6),
        "jpeg data": lambda n: b"\xff\xd8\xff\xc0\0\x02\xff\xda\0\x02ab" * (n // 12),
        "riff": lambda n: b"".join(b"RIFF" + struct.pack("<I", n - 20 * i - 8) + b"WAVE" + b"data" + bytes(4) for i in range(n // 20)),
        "ogg end": lambda n: page * (n // 27) + b"OggS\0\x04" + bytes(21),
        "gif end": lambda n: gif + b"\0" + b"\x21\0" + (bytes([13]) + gif + b"\0") * (n // 14) + b"\0;",
    }
    for name, chain in chains.items():
        once, four = (min(seconds(chain(n)) for _ in range(2)) for n in (1 << 16, 1 << 18))
        assert four < 0.1 + 4 * 2 * once, (name, once, four)
    ended = media.signatures(chains["ogg end"](2700))
    assert len(ended) == 101 and {f.end for f in ended} == {2727}
    archive = b"PK\x03\x04" + bytes(10) + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 1, 1, 4, 10, 0)
    assert media.carve(b"??" + archive + b"??") == [media.Found("application/zip", 2, 2 + len(archive))]


def test_whole_licenses_and_words_that_only_hash_alike(spark, tmp_path):
    mit = licenses._MIT.replace("software", "program", 3).upper()
    half = " ".join(licenses._MIT.split()[40:100])
    docs = spark.createDataFrame([(1, "Copyright (c) 2020 X\n" + mit, "l", 1), (2, half, "l", 1), (3, licenses._ISC + " and " + licenses._BSD_2, "l", 1)], "doc_id bigint, text string, label string, votes int")
    spans = licenses.license_spans(spark, docs).where("NOT exact AND cover >= 0.75").collect()
    assert {(r.doc_id, r.label) for r in spans if r.to_word - r.from_word > 100} == {(1, "mit"), (3, "isc"), (3, "bsd")}
    assert not [r for r in spans if r.doc_id == 2]
    got = {r.doc_id: r.labels for r in licenses.op4(spark, write_tables(spark, tmp_path, documents=docs)).collect()}
    assert got == {1: "mit", 2: "", 3: "bsd,isc"}
    with pytest.raises(ValueError):
        licenses.license_spans(spark, docs, [("mit license", "mit")], [])


def test_common_grams_of_a_large_benchmark(spark, monkeypatch):
    """Many items with one common passage, joined by shuffle: the same hits as by brute force."""
    monkeypatch.setattr(tk, "BROADCAST_BYTES", 0)
    rng = random.Random(17)
    some = " ".join(f"c{i}" for i in range(14))
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    bench = [(i, f"{text(rng.randint(0, 9))} {some} {text(rng.randint(0, 9))}") for i in range(60)] + [(60 + i, text(rng.randint(0, 14))) for i in range(10)]
    docs = [(i, f"{text(30)} {some if i % 2 else 'c1 c2 c3 c4 c5'} {text(rng.randint(0, 40))}") for i in range(40)]
    frame = lambda rows_, name: spark.createDataFrame(rows_, f"{name} bigint, text string")
    assert len(decontaminate._common_grams(spark, frame(bench, "item_id"), 5)) >= 10
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontaminate.decontaminate(spark, frame(docs, "doc_id"), frame(bench, "item_id")).collect()}
    assert got == {i: brute_hits(t, bench) for i, t in docs}
