"""Line dedup deletes maximal runs: every run of lines with words enough that is a later copy, however long."""

import random
import re

from graphloom.llm import linededup


def brute_runs(texts, least):
    """Texts in order, less every run of lines, of any length, that has least words and an earlier copy that it doesn't overlap."""
    split = [[(n, x.strip(" \t\n\r\v\f"), len(re.findall(r"[^\x20\x09-\x0D]+", x))) for n, x in enumerate((t or "").split("\n"))] for t in texts]
    split = [[x for x in s if x[2]] for s in split]
    seen, gone = {}, [set() for _ in texts]
    for d, s in enumerate(split):
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                if sum(x[2] for x in s[i:j]) >= least:
                    f = seen.setdefault(tuple(x[1] for x in s[i:j]), (d, i))
                    if f[0] != d or i >= f[1] + (j - i):
                        gone[d] |= {x[0] for x in s[i:j]} | set(range(s[i][0], s[j - 1][0] + 1))
    return [None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in g) for t, g in zip(texts, gone, strict=True)]


def left(spark, texts, least):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark, docs, least).collect()}
    return [got[i] for i in range(len(texts))]


def test_a_run_goes_to_its_end(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 49), ("b", 1), ("c", 40)))
    # the end of a text, a line of its own after the run, and a longer copy of a text that is not the first to hold its start
    texts = [f"{a}\n{b}\nx", f"y\n{a}\n{b}\n{c}", f"{a}\n{b}\n{c}", f"{a}\n{b}\n{c}\nz", f"{c}\n{b}"]
    assert left(spark, texts, 50) == [texts[0], f"y\n{c}", "", "z", texts[4]] == brute_runs(texts, 50)


def test_runs_match_brute_force(spark):
    rng = random.Random(6)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice((1, 1, 2, 9)))) for _ in range(9)] + ["", " "]
    passage = [rng.choice(pool) for _ in range(25)]
    texts = []
    for _ in range(40):
        at = rng.randint(0, 24)
        texts.append("\n".join([rng.choice(pool) for _ in range(rng.randint(0, 9))] + passage[at : at + rng.randint(0, 25)] + [rng.choice(pool) for _ in range(rng.randint(0, 4))]))
    texts += [None, "", "\n\n"]
    for least in (1, 7, 13):
        assert left(spark, texts, least) == brute_runs(texts, least), least
