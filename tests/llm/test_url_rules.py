"""Mined url rules of any length, against a brute-force miner."""

import math
import random
import time
from itertools import combinations, product

from graphloom.llm import urls


def mined(spark, rows, **how):
    """{(tokens of each item, sorted; verdict): (confidence, support)}."""
    rules, items = urls.mine(spark, spark.createDataFrame(rows, "tokens array<string>, ruled string"), **how)
    alike = {}
    for r in items.collect():
        alike.setdefault(r.item, []).append(r.token)
    return {(tuple(sorted(tuple(sorted(alike[i])) for i in r["items"])), r.verdict): (r.confidence, r.support) for r in rules.collect()}


def brute_miner(rows, min_support=urls.MIN_SUPPORT, min_confidence=urls.MIN_CONFIDENCE):
    """Rules over all itemsets of any size, pruned by support, confidence and redundancy; then tokens that always occur together as one item."""
    sets = [(frozenset(t), v) for t, v in rows]
    least, of = max(1, math.ceil(min_support * len(sets))), {v: sum(w == v for _, w in sets) for _, v in sets}
    rules = {}
    for k in range(1, max((len(t) for t, _ in sets), default=0) + 1):
        for x in {frozenset(c) for t, _ in sets for c in combinations(sorted(t), k)}:
            held = [v for t, v in sets if x <= t]
            for v in set(held):
                sure = held.count(v) / len(held)
                if held.count(v) >= least and sure >= min_confidence and sure * len(sets) > of[v]:
                    rules[x, v] = (sure, held.count(v) / len(sets))
    rules = {(x, v): r for (x, v), r in rules.items() if not any((x - {t}, v) in rules and rules[x - {t}, v][0] >= r[0] for t in x)}
    rows_of = {}
    for t in {t for s, _ in sets for t in s}:
        rows_of.setdefault(frozenset(i for i, (s, _) in enumerate(sets) if t in s), []).append(t)
    item = {t: tuple(sorted(alike)) for alike in rows_of.values() for t in alike}
    return {(tuple(sorted(item[t] for t in x)), v): r for (x, v), r in rules.items()}


def test_mined_rules_match_brute_force(spark):
    rng = random.Random(8)
    for n in range(6):
        letters = "abcdefg"[: rng.randint(2, 7)]
        rows = []
        for _ in range(rng.randint(1, 40)):
            tokens = [t for t in letters if rng.random() < rng.choice((0.2, 0.6, 0.9))]
            if "a" in tokens and n % 2:
                tokens += ["x", "y"]  # that always come with a
            rows.append((tokens, rng.choice(["allow", "block"]) if rng.random() < 0.4 or "b" not in tokens else "block"))
        how = {"min_support": rng.choice((0.01, 0.1, 0.3)), "min_confidence": rng.choice((0.5, 0.7, 1.0))}
        assert mined(spark, rows, **how) == brute_miner(rows, **how), (n, rows, how)


def test_long_shared_paths_end(spark):
    """Paths that many urls share, whole and cut at any depth, have rules as many as prefixes, not as subsets."""
    began = time.perf_counter()
    for depth in (18, 40):
        path = "/".join(f"d{i}x" for i in range(depth))
        pages = [(i, f"http://h{i}.example.com/en/{path}/" if i % 2 else f"http://h{i}.example.com/q/") for i in range(40)]
        pages += [(100 + i, f"http://k{i}.example.com/en/" + "/".join(path.split("/")[: i + 1])) for i in range(depth)] + [(999, f"http://z.org/{path}")]
        got = {r.page_id: r for r in urls.judge(spark, spark.createDataFrame(pages, "page_id bigint, url string")).collect()}
        assert got[999].verdict == "block" and got[999].by == "mined" and len(got) == len(pages)
    assert time.perf_counter() - began < 120


def test_a_rule_of_four_tokens_is_kept(spark):
    # a verdict that only all four tokens together give; every three of them go with the other one half of the time
    rows = [(["a", "b", "c", "d"], "block")] * 10
    rows += [([t for t, on in zip("abcd", held, strict=True) if on], "allow") for held in product((0, 1), repeat=4) if sum(held) < 4 for _ in range(10)]
    got = {x: r[0] for (x, v), r in mined(spark, rows).items() if v == "block"}
    assert got == {(("a",), ("b",), ("c",), ("d",)): 1.0}


def test_ties_long_urls_and_clashing_columns(spark):
    """Two mined rules as sure and as frequent: the one with more tokens, then the greater tokens, decides; very long urls are read whole."""
    far = "/x" * 20_000
    pages = [(i, f"http://a{i}.example.com/en/{i}") for i in range(40)] + [(50 + i, f"http://a{i}.example.com/de/{i}") for i in range(40)] + [(100, f"http://b.org{far}/en/"), (101, "http://c.org" + far), (None, f"http://d.example.com/en{far}"), (102, None)]
    docs = spark.createDataFrame([(*p, "r", "v", 1) for p in pages], "page_id bigint, url string, rule string, verdict string, key int")
    got = {r.page_id: r for r in urls.judge(spark, docs).collect()}
    assert got[100].verdict == "block" and got[100].by == "mined" and got[101].by in ("mined", "default") and got[None].rule == "example.com/en/" and got[102].host == ""
    assert len(got[100].path) == len(far) + 4
    tied = [(["a", "z"], "block")] * 10 + [(["b", "z"], "allow")] * 10 + [(["q"], "allow")] * 2
    got = {(x, v, r[0]) for (x, v), r in mined(spark, tied).items()}
    assert got >= {((("a",),), "block", 1.0), ((("b",),), "allow", 1.0)}
