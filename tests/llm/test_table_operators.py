import collections
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import bpe, chats, graph, langid, linededup, neardup, queries, urls
from graphloom.llm import textkit as tk
from graphloom.operators import joins

from ..conftest import rows
from .conftest import write_tables
from .test_line_runs import brute_runs

SF = "/root/testdata/sf0.001"


def normal(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in df[columns].itertuples(index=False))


def test_brute_lines_are_the_runs():
    rng = random.Random(12)
    for _ in range(60):
        texts = ["\n".join(rng.choice(["a", "b", "c d", ""]) for _ in range(rng.randint(0, 14))) for _ in range(5)]
        assert brute_lines(texts, 4) == brute_runs(texts, 4)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert normal(queries.QUERIES[name](spark, SF).toPandas()) == normal(con.execute(queries.ORACLE_SQL[name]).df())


# components
def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 501 + i) for i in range(30)] + [(7, 7)]
    parent = list(range(600))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = dict(rows(graph.components(spark, spark.createDataFrame(links, "a bigint, b bigint"))))
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}
    assert graph.components(spark, spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """Links that hang on their roots already are told by their minima; a chain takes rounds."""
    stored = []
    store = tk.Steps.store
    monkeypatch.setattr(tk.Steps, "store", lambda self, df: stored.append(1) or store(self, df))
    stars = [(r, r + 1 + i) for r in (100, 200) for i in range(20)]
    got = dict(rows(graph.components(spark, spark.createDataFrame([*stars, *stars, (5, 5)], "a bigint, b bigint"))))
    assert got == {x: a for a, b in stars for x in (a, b)}
    assert len(stored) == 2
    got = dict(rows(graph.components(spark, spark.createDataFrame([(3, 2), (2, 1), (3, 4)], "a bigint, b bigint"))))
    assert got == dict.fromkeys([1, 2, 3, 4], 1)


# 6: line dedup
def brute_lines(texts, least):
    """Texts in order, less later copies of maximal runs: from each line on, the longest run that has an earlier copy which it doesn't overlap, if it has least words."""
    split = [[(n, x.strip(" \t\n\r\v\f"), len(re.findall(r"[^\x20\x09-\x0D]+", x))) for n, x in enumerate((t or "").split("\n"))] for t in texts]
    split = [[x for x in s if x[2]] for s in split]
    places, gone = collections.defaultdict(list), [set() for _ in texts]
    for d, s in enumerate(split):
        for i in range(len(s)):
            longest = 0
            for e, f in places[s[i][1]]:
                n = 0
                while i + n < len(s) and f + n < len(split[e]) and s[i + n][1] == split[e][f + n][1] and (e != d or f + n < i):
                    n += 1
                longest = max(longest, n)
            if sum(x[2] for x in s[i : i + longest]) >= least:
                gone[d] |= set(range(s[i][0], s[i + longest - 1][0] + 1))
            places[s[i][1]].append((d, i))
    return [None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in g) for t, g in zip(texts, gone, strict=True)]


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(2)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(12)] + ["", " ", "\t"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(40)] + [None, "", "\n\n"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for least in (1, 5, 13):
        got = {r.doc_id: r.text for r in linededup.dedup_lines(spark, docs, least).collect()}
        assert [got[i] for i in range(len(texts))] == brute_lines(texts, least), least


def test_line_dedup_odd_rows(spark, odd_docs, no_docs):
    passage = "\n".join(f"line {i} of a passage with some ten words in it" for i in range(6))
    docs = odd_docs.unionByName(odd_docs.where("doc_id = 1").withColumn("doc_id", F.lit(50)).withColumn("text", F.lit("own start\n" + passage + "\nown end")))
    docs = docs.unionByName(odd_docs.where("doc_id = 1").withColumn("doc_id", F.lit(51)).withColumn("text", F.lit(passage)))
    done = linededup.drop_copies(spark, docs)
    assert done.columns == odd_docs.columns
    left = {r.doc_id: r.text for r in done.collect() if r.doc_id in (50, 51)}
    assert left == {50: "own start\n" + passage + "\nown end"}
    assert rows(done.where("doc_id NOT IN (50, 51) OR doc_id IS NULL")) == rows(odd_docs)
    assert linededup.drop_copies(spark, no_docs).count() == 0
    with pytest.raises(ValueError):
        linededup.dedup_lines(spark, odd_docs)


# 7: near duplicates
def brute_components(docs, k, percent):
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("limit", [400, 6])
def test_near_duplicates_match_brute_force(spark, monkeypatch, limit):
    """With a tiny LIMIT, nodes branch on and large ones are dealt out in blocks."""
    monkeypatch.setattr(neardup, "LIMIT", limit)
    monkeypatch.setattr(neardup, "BRANCH", 10_000 if limit > 10 else 4)
    rng = random.Random(9)
    docs = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(4, 150))]
        docs += [" ".join(edited(rng, base, rng.choice([0, 0, 1, 2, 4, 9]))) for _ in range(rng.choice([1, 2, 12]))]
    docs += ["", None, "one", "One", "two words", "two  WORDS", "a b c", "  "]
    pairs = list(enumerate(docs))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark, spark.createDataFrame(pairs, "doc_id bigint, text string"), 3, 85).collect()}
    assert got == brute_components(pairs, 3, 85)


def test_one_of_each_group_stays(spark, odd_docs, no_docs):
    left = neardup.keep_one(spark, odd_docs)
    assert left.columns == odd_docs.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 0, 1, 3, 4, 5, 6, 7, 7, 8, 9, 10]
    assert neardup.keep_one(spark, no_docs).count() == 0


def test_a_large_group_of_alike_texts(spark):
    """Hundreds of texts that differ in a few words are one component; no step grows with their pairs."""
    rng = random.Random(10)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    docs = [(i, " ".join(edited(rng, base, 2))) for i in range(900)] + [(i, f"all alone {i} w{i} v{i}") for i in range(900, 950)]
    got = neardup.near_duplicates(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), 3, 85).collect()
    assert {r.component_id for r in got if r.doc_id < 900} == {0}
    assert all(r.component_id == r.doc_id for r in got if r.doc_id >= 900)


def test_pairs_at_the_threshold_meet_at_any_depth(spark):
    """Sketches that agree in each place with the threshold's probability share a node of the deepest level in some tree."""
    import numpy as np

    rng, n, s = np.random.default_rng(18), 400, 0.85
    one = rng.integers(0, 2**32, (n, neardup.SKETCH), dtype=np.uint32)
    two = np.where(rng.random(one.shape) < s, one, rng.integers(0, 2**32, one.shape, dtype=np.uint32))
    values = np.concatenate([one, two])
    rows_, nodes = neardup.paths(values, s)
    level = spark.createDataFrame(list(zip(rows_.tolist(), nodes.view(np.int64).tolist(), strict=True)), "rid bigint, node bigint")
    reps = spark.createDataFrame([(i, bytearray((v & 255).astype(np.uint8).tobytes())) for i, v in enumerate(values)], "rid bigint, sketch binary")
    pair = F.col("rid") % n
    for depth in range(2, neardup.DEPTH + 1):
        both = level.groupBy(pair.alias("pair"), "node").agg(F.countDistinct("rid").alias("c")).where("c = 2")
        met = both.select("pair").distinct().count()
        assert met >= n - 1, depth
        together = both.select("pair", "node")
        level = level.withColumn("pair", pair).join(together, ["pair", "node"]).select("rid", "node")
        level = tk.shared_checkpoint(spark, neardup._children(level, reps, s))


def test_sketches_at_the_threshold_pass(spark):
    """Of 10,000 pairs whose sketches agree in each place with the threshold's probability, none is dropped; of as many unlike ones, all are."""
    import numpy as np
    import pyarrow as pa

    n = 10_000
    for percent in (80, 85):
        rng = np.random.default_rng(percent)
        one = rng.integers(0, 256, (n, neardup.SKETCH), dtype=np.uint8)
        for share, kept in ((percent / 100, n), (0.2, 0)):
            two = np.where(rng.random(one.shape) < share, one, rng.integers(0, 256, one.shape, dtype=np.uint8))
            both = np.stack([one, two], axis=1).reshape(2 * n, -1)
            pairs = pa.table({"group": np.repeat(np.arange(n), 2), "cls": np.arange(2 * n), "side": np.full(2 * n, -1), "sketch": pa.array([x.tobytes() for x in both], pa.binary())})
            x, y, _ = neardup._pairs(pairs, percent)
            assert len(x) == kept and (y == x + 1).all()
        chance = lambda m, t, p=percent / 100: sum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(t))
        for m in (32, 128):
            assert chance(m, neardup._least(percent, m)) <= neardup.MISSED < chance(m, neardup._least(percent, m) + 1)


@pytest.mark.parametrize("what", ["salts", "blocks"])
def test_hot_keys_and_long_texts_are_dealt_out(spark, monkeypatch, what):
    """Every join by shuffle and salts, or full sets in blocks of a few shingles: the same components."""
    monkeypatch.setattr(tk, "BROADCAST_BYTES", -1) if what == "salts" else monkeypatch.setattr(neardup, "ITEMS", 300)
    monkeypatch.setattr(joins, "HOT_SHARE", 20)
    monkeypatch.setattr(neardup, "LIMIT", 10)
    rng = random.Random(19)
    base = [f"w{rng.randrange(5000)}" for _ in range(90)]
    docs = [" ".join(edited(rng, base, rng.choice([0, 1, 3, 5, 7]))) for _ in range(60)] + [" ".join(base[:40] + [f"z{rng.randrange(99)}" for _ in range(30)]) for _ in range(20)]
    pairs = list(enumerate(docs))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark, spark.createDataFrame(pairs, "doc_id bigint, text string"), 3, 85).collect()}
    assert got == brute_components(pairs, 3, 85)


# 8: url filter
RULES = [(h + p, h, p, v) for h, p, v in urls.RULES]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate({c: c + 32 for c in range(65, 91)})
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[0]), default=None)
    return host, path, best and best[0], best and best[3]


def test_url_rules_match_brute_force(spark, tmp_path):
    rng = random.Random(11)
    parts = [rng.choice(["http://", "https://", "", "HTTP://"]) + rng.choice(["www.", "", "m.", "WWW."]) + rng.choice(["example", "Other", "x.example"]) + rng.choice([".com", ".net", ".org", "com", ".com:80"]) + rng.choice(["", "/", "/en/", "/en", "/es/1", "/fr/9.html", "?q=/en/", "#/fr/"]) + rng.choice(["", "a/b", "?x=1", "#t", "://z"]) for _ in range(500)]
    pages = [*enumerate(parts), (900, None), (901, ""), (902, "://"), (None, "http://a.com/"), (0, parts[0])]
    d = write_tables(spark, tmp_path, pages=spark.createDataFrame([(*p, "h", "v") for p in pages], "page_id bigint, url string, html string, verdict string"))
    got = urls.op8(spark, d).collect()
    assert len(got) == len(set(pages))
    said = collections.defaultdict(set)
    for i, u in pages:
        said[i].add(brute_url(u))
    for r in got:
        match = [x for x in said[r.page_id] if x[:3] == (r.host, r.path, r.rule)]
        assert match and r.verdict == match[0][3] if r.rule else match and r.verdict in ("allow", "block")
    assert urls.op8(spark, write_tables(spark, tmp_path / "e", pages=spark.createDataFrame([], "page_id bigint, url string"))).count() == 0


def test_mined_rules_generalize(spark):
    pages = [(i, f"http://s{i}.example.com/{'en' if i % 2 else 'de'}/{i}") for i in range(100)] + [(100 + i, f"http://s{i}.example.org/{'en' if i % 2 else 'de'}/{i}") for i in range(20)]
    got = urls.judge(spark, spark.createDataFrame(pages, "page_id bigint, url string")).where("rule IS NULL").collect()
    assert {(r.page_id % 2, r.verdict, r.by) for r in got} == {(1, "block", "mined"), (0, "allow", "mined")}


# 10: chats
def test_snapshots_collapse(spark):
    talk = lambda c, n, tail="": [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t}{tail if t == n - 1 else ''}") for t in range(n)]
    data = talk(1, 2) + talk(2, 4) + talk(3, 4) + talk(4, 3, "!") + [(5, 0, None, None), (5, 0, None, None), (6, None, "user", "x"), (None, 0, "user", "lost"), (7, 0, "user", "t0")]
    got = {r.conv_id: (r.n_turns, r.n_collapsed, r.chat) for r in chats.render(spark, spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert set(got) == {2, 4, 5, 6}
    assert got[2][:2] == (4, 1) and got[5] == (1, 0, "<|im_start|>unknown\n<|im_end|>\n") and got[4][2].endswith("<|im_start|>user\nt2!<|im_end|>\n")
    assert chats.render(spark, spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_chats_of_long_texts_ties_and_clashing_columns(spark):
    long = "wort é\n" * 100_000
    data = [(1, 0, "user", long), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (2, 0, "user", long), (3, 0, "user", long + "x"), (4, 0, "", ""), (5, 0, "", "")]
    table = spark.createDataFrame([(*r, 1, "c", True) for r in data], "conv_id bigint, turn bigint, role string, text string, place int, chat string, last boolean")
    got = {r.conv_id: (r.n_turns, r.n_collapsed, r.chat) for r in chats.render(spark, table).collect()}
    one = "<|im_start|>user\n" + long + "<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert got == {1: (3, 0, one), 3: (1, 0, f"<|im_start|>user\n{long}x<|im_end|>\n"), 4: (1, 1, "<|im_start|>\n<|im_end|>\n")}


@pytest.mark.parametrize("name", ["op8_url_filter", "op10_chat_format"])
def test_native_queries_run_no_python(spark, name, monkeypatch):
    """No plan that ran on the way, the steps' own included, has a Python operator, and no rows come out of Python."""

    def none(*_, **__):
        raise AssertionError("rows made in Python")

    for method in ("parallelize", "runJob"):
        monkeypatch.setattr(type(spark.sparkContext), method, none)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    queries.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    plans = [store.executionsList(int(i), 1).apply(0).physicalPlanDescription() for i in range(before, store.executionsCount())]
    assert len(plans) > 1 and any("Scan parquet" in p for p in plans)
    assert not any(re.search("Python|Pandas|Arrow", p) for p in plans)


# the pipeline
def test_pipeline_stages(spark, odd_docs, no_docs, items, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "bpe"]
    d = write_tables(spark, tmp_path, documents=odd_docs, benchmark=items)
    for kind, docs in (("odd", odd_docs), ("none", no_docs)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, d)
            assert out.columns == docs.columns or name == "bpe"
            out.write.parquet(str(tmp_path / f"{name}-{kind}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}-{kind}")) if name != "bpe" else out


def test_pipeline_over_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF).collect()
    texts = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    lines = dict(zip([i for i, _ in texts], brute_lines([t for _, t in texts], linededup.MIN_WORDS), strict=True))
    left = [(i, t) for i, t in lines.items() if t == dict(texts)[i] or t.split()]
    groups = brute_components(left, 5, 80)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    from .test_text_operators import brute_hits

    left = [(i, t) for i, t in left if not brute_hits(t, list(bench.items()))[1]]
    tok = bpe.tokenizer(bpe.default_path())
    assert {r.doc_id: r.input_ids for r in got} == {i: tok.encode(t) for i, t in left}
    assert tk.table(spark, SF, "documents").count() == len(texts) and langid.UNKNOWN == "und"


def test_steps_leave_only_what_is_kept(spark):
    from graphloom.operators.storage import folder, names

    before = {n for n, _ in names(spark, folder(spark))}
    with tk.Steps(spark) as steps:
        a = steps.store(spark.range(10))
        b = steps.store(a.where("id > 3"))
        steps.drop(a)
        assert len({n for n, _ in names(spark, folder(spark))} - before) == 1
        kept = steps.keep(b.where("id > 7"))
    assert len({n for n, _ in names(spark, folder(spark))} - before) == 1 and kept.count() == 2


def test_parts_and_without(spark, odd_docs):
    keys = tk.shared_checkpoint(spark, tk.keyed_texts(odd_docs).where("doc_id IN (1, 7) AND text NOT LIKE 'x%'").select("doc_id", "text_key"))
    some, rest = tk.parts(spark, odd_docs, keys)
    assert rows(some.unionAll(rest)) == rows(odd_docs) and some.columns == odd_docs.columns
    assert rows(tk.without(spark, odd_docs, keys)) == rows(odd_docs.where("doc_id IS NULL OR doc_id NOT IN (1, 7) OR text LIKE 'x%'"))


def test_salted_joins_are_joins(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_SHARE", 10)
    rng = random.Random(20)
    many = [(rng.choice([1, 1, 1, 2, 3, 4, 5, None]), i) for i in range(400)]
    one = [(k, f"v{k}") for k in (1, 2, 3, 9)]
    m, o = spark.createDataFrame(many, "k int, hot_salt int"), spark.createDataFrame(one, "k int, v string")
    counts = m.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        assert rows(tk.skew_join(m, o, counts, ["k"], how)) == rows(m.join(o, "k", how))
    text = spark.createDataFrame([("x" * 100, [1, 2, 3], (1, "yy"), ["a"])], "s string, a array<int>, t struct<i:int,u:string>, l array<string>")
    assert 150 < text.agg(F.sum(tk.row_bytes(text))).first()[0] < 500
