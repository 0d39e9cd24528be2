"""BPE encoding and decoding by a tokenization automaton (operator 5).

Automaton() builds, from the merge list alone, the deterministic automaton over
tokens that accepts exactly the token strings which the merges produce. It
starts from one state in which every base symbol loops. For each merge (u, v),
in order, a gadget is put in: the u arcs are led to a copy of their target that
lacks the v arc, and wherever a u arc leaves, an arc uv is added, which ends
where v from there ended. All arcs of a token thus share one target, so a state
is "the last token read", and what a state lacks is what its copies have lost.

It is compiled to tables: a table of gadgets (u, v) -> step, the parts of each
token and when it was made, and a trie of the labels. Whether an arc of token y
leaves the state of token x is read off the gadgets: y is lost if, at some time
before either of them was made whole, the piece at the end of x and the piece
at the start of y had a gadget; the pieces change a few times only.

Encoding goes through a word once, from left to right, without a search: each
prefix has one tokenization, so the state after it is one token, and the
tokens that continue it are those of the trie whose arcs leave that state. The
full table of states and arcs, a few billion of them, is never written out: an
arc is compiled from the gadgets when a word first asks for it, and kept. Whole
batches of words take each step together, in arrays. Decoding emits the labels
of the arcs. Texts are split, and their tokens put together, as Arrow columns:
each distinct stretch without white space is looked at once a batch.

Nulls: a null text is empty (no tokens); a null doc_id stays. Repeated rows are
kept. Ties cannot occur: the automaton is deterministic. An empty table gives an
empty one. Columns other than doc_id and text, whatever their names, are not
looked at. Whole texts; tables of known words have a bounded number of entries.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

#: Entries of each of a worker's tables (words, and words as they stand in the text), of which those not used lately go when they are full.
CACHE_WORDS = 240_000
#: Longer words and longer stretches of text without white space are not kept.
KEPT_LETTERS = 60
#: Longer words are encoded alone, letter by letter.
LONG_WORD = 1_000
#: Bytes of text, or one text, that are encoded at once.
BATCH_BYTES = 1 << 21
#: Letters of words that take their steps together, unless one word has more: a step's arrays take some 100 bytes a letter.
STEP_LETTERS = 1 << 15
#: Pairs of tokens whose arc a worker remembers: 9 bytes each.
_REMEMBERED = 1 << 19
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class _Table:
    """An immutable hash table from non-negative 64-bit keys to 32-bit values, read by arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        size = 1 << max(4, int(len(keys) * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):  # each free slot takes one of the keys that want it; the others go on to the next slot
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]
            mine = self.keys[at] == keys[left]
            self.values[at[mine]] = values[left[mine]]
            left, at = left[~mine], (at[~mine] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys, -1 where there is none."""
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            held = self.keys[at]
            mine = held == keys[left]
            out[left[mine]] = self.values[at[mine]]
            on = ~mine & (held >= 0)
            left, at = left[on], at[on]
        return out


class Automaton:
    """The tokenization automaton of a merge list, and its tables."""

    def __init__(self, base: list[str], merges: list[tuple[str, str]], suffix: str = "") -> None:
        self.suffix = suffix
        self.labels: list[str] = list(base)
        self.ids: dict[str, int] = {s: i for i, s in enumerate(base)}
        self.state = [0] * len(base)  # where the arcs of each token lead; state 0 is the first one
        self.copied_from, self.lost, self.since = [-1], [-1], [-1]  # of each state
        self.left: list[int] = [-1] * len(base)  # of each token that a merge makes, its left part,
        self.right: list[int] = [-1] * len(base)
        self.made: list[int] = [-1] * len(base)  # and the number of the merge
        for step, (a, b) in enumerate(merges):
            self._gadget(step, self.ids[a], self.ids[b], a + b)
        self._compile()

    def _gadget(self, step: int, u: int, v: int, label: str) -> None:
        if label in self.ids:
            raise ValueError(f"two merges make {label!r}")
        self.ids[label] = len(self.labels)
        self.labels.append(label)
        self.state.append(self.state[v])
        self.left.append(u)
        self.right.append(v)
        self.made.append(step)
        self.copied_from.append(self.state[u])
        self.lost.append(v)
        self.since.append(step)
        self.state[u] = len(self.copied_from) - 1

    def leaves(self, state: int, token: int) -> bool:
        """Whether the state has an arc of that token, by the states' own records: what the tables are tested against."""
        made = self.made[token]
        while self.since[state] > made:  # copies that later merges made: they lack the arc they lost
            if self.lost[state] == token:
                return False
            state = self.copied_from[state]
        # the state as the token's merge found or made it: the arc was added where the left part's stood
        return made < 0 or self.leaves(state, self.left[token])

    # tables
    def _compile(self) -> None:
        n = len(self.labels)
        left, right, made = (np.array(x, np.int64) for x in (self.left, self.right, self.made))
        self._parts = left, right, made
        whole = np.flatnonzero(made >= 0)
        self._gadgets = _Table(left[whole] * n + right[whole], made[whole].astype(np.int32))
        self.code = {c: i for i, c in enumerate(sorted({c for label in self.labels for c in label.removesuffix(self.suffix)}))}
        letters, wide = [label.removesuffix(self.suffix) if self.suffix else label for label in self.labels], len(self.code)
        self._next: dict[int, int] = {}
        plain, ended = [-1], [-1]
        for token, (label, text) in enumerate(zip(self.labels, letters, strict=True)):
            node = 0
            for c in text:
                key = node * wide + self.code[c]
                node = self._next.get(key, -1)
                if node < 0:
                    node = self._next[key] = len(plain)
                    plain.append(-1)
                    ended.append(-1)
            if not self.suffix or label.endswith(self.suffix) and label != text:
                ended[node] = token
            if not self.suffix or label == text:
                plain[node] = token
        self._wide, self._plain, self._ended = wide, np.array(plain, np.int32), np.array(ended, np.int32)
        self._trie = _Table(np.fromiter(self._next.keys(), np.int64), np.fromiter(self._next.values(), np.int32))
        self._pairs, self._arcs = np.full(_REMEMBERED, -1, np.int64), np.zeros(_REMEMBERED, bool)

    def arcs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether an arc of token y leaves the state of token x (-1: the first state), for arrays of both."""
        n = len(self.labels)
        key = np.where(x < 0, np.int64(n) * n, x.astype(np.int64) * n) + y
        at = ((key.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _REMEMBERED.bit_length() + 1)).astype(np.int64)
        known = self._pairs[at] == key
        out = self._arcs[at]
        if not known.all():
            missing = np.flatnonzero(~known)
            unique, first, inverse = np.unique(key[missing], return_index=True, return_inverse=True)
            found = self._lookup(x[missing[first]].astype(np.int64), y[missing[first]].astype(np.int64))
            out[missing] = found[inverse]
            slots = at[missing[first]]
            self._pairs[slots], self._arcs[slots] = unique, found
            again = self._pairs[slots] != unique  # two pairs for one slot: the last one is remembered, with its own arc
            if again.any():
                self._pairs[slots[again]] = -1
        return out

    def _lookup(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        left, right, made = self._parts
        n = len(self.labels)
        out = np.ones(len(x), bool)
        on = np.flatnonzero(x >= 0)  # every arc leaves the first state
        x, y, before = x[on], y[on], np.full(len(on), np.iinfo(np.int64).max)
        while len(on):
            step = self._gadgets.get(x * n + y)
            lost = (step >= 0) & (step < before)
            out[on[lost]] = False
            later = made[x] > made[y]
            go = ~lost & ((made[x] >= 0) | (made[y] >= 0))
            on, x, y, before, later = on[go], x[go], y[go], before[go], later[go]
            # back in time to before the younger one of the two was made; a merge puts its arc where its left part's stands, so y's own step counts
            before = np.minimum(before, np.where(later, made[x], made[y] + 1))
            x, y = np.where(later, right[x], x), np.where(later, y, left[y])
        return out

    def follows(self, before: int, token: int) -> bool:
        """Whether token may come right after the token before, or (-1) first."""
        return bool(self.arcs(np.array([before]), np.array([token]))[0])

    # encoding
    def encode_words(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words, how many each word has) of words codes[bounds[i]:bounds[i + 1]], none of them empty."""
        sizes = np.diff(bounds)
        word = np.repeat(np.arange(len(sizes)), sizes)
        start, stop = bounds[:-1][word], bounds[1:][word]
        # every label that occurs, from each letter on
        at, node, far = np.arange(len(codes), dtype=np.int64), np.zeros(len(codes), np.int64), 0
        begins, ends, tokens = [], [], []
        while len(at):
            node = self._trie.get(node * self._wide + codes[at + far]).astype(np.int64)
            on = node >= 0
            at, node = at[on], node[on]
            far += 1
            last = at + far == stop[at]
            token = np.where(last, self._ended[node], self._plain[node])
            is_one = token >= 0
            begins.append(at[is_one])
            ends.append(at[is_one] + far)
            tokens.append(token[is_one])
            at, node = at[~last], node[~last]
        begin, end, token = np.concatenate(begins), np.concatenate(ends), np.concatenate(tokens)
        reach = end - start[begin]
        order = np.argsort(reach, kind="stable")
        begin, end, token = begin[order], end[order], token[order]
        cuts = np.searchsorted(reach[order], np.arange(1, (int(sizes.max()) if len(sizes) else 0) + 2))
        # the state after each prefix, for all words a letter further at a time
        state, back = np.full(len(codes) + 1, -1, np.int64), np.zeros(len(codes) + 1, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            first = begin[a:b] == start[begin[a:b]]
            before = np.where(first, -1, state[begin[a:b]])
            ok = (first | (before >= 0)) & self.arcs(before, token[a:b])
            state[end[a:b][ok]], back[end[a:b][ok]] = token[a:b][ok], begin[a:b][ok]
        counts = np.zeros(len(sizes), np.int64)
        steps, at, which = [], bounds[1:].copy(), np.arange(len(sizes))
        while len(which):
            if (state[at] < 0).any():
                raise ValueError("a word has no tokens: a letter is not in the base")
            steps.append((which, state[at]))
            counts[which] += 1
            at = back[at]
            on = at > bounds[which]
            at, which = at[on], which[on]
        out, upto = np.empty(int(counts.sum()), np.int64), np.cumsum(counts)
        for i, (which, found) in enumerate(steps):
            out[upto[which] - 1 - i] = found
        return out, counts

    def encode(self, letters: str) -> list[int]:
        """The tokens of one word, whose last letter carries the suffix."""
        n = len(letters)
        state, back = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            if i and state[i] < 0:
                continue
            node, tokens, ends = 0, [], []
            for j in range(i, n):
                node = self._next.get(node * self._wide + self.code.get(letters[j], self._wide), -1) if letters[j] in self.code else -1
                if node < 0:
                    break
                token = int(self._ended[node] if j + 1 == n else self._plain[node])
                if token >= 0:
                    tokens.append(token)
                    ends.append(j + 1)
            if tokens:
                y = np.array(tokens)
                for token, end, ok in zip(tokens, ends, self.arcs(np.full(len(y), state[i] if i else -1), y).tolist(), strict=True):
                    if ok:
                        state[end], back[end] = token, i
        out = []
        while n:
            if state[n] < 0:
                raise ValueError(f"no tokens for {letters!r}")
            out.append(state[n])
            n = back[n]
        return out[::-1]

    def decode(self, tokens: Iterable[int]) -> list[str]:
        return [self.labels[t] for t in tokens]


class _Kept:
    """Token lists of strings; those used lately are kept, as Arrow columns."""

    def __init__(self) -> None:
        self.strings, self.tokens = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))
        self.used = np.zeros(0, bool)

    def get(self, strings: pa.Array, make: Callable[[pa.Array], pa.Array], most: int) -> pa.Array:
        """The token lists of distinct strings; make has those of the strings that are not kept. At most that many are kept."""
        at = pc.index_in(strings, value_set=self.strings)
        new = strings.filter(at.is_null())
        if not len(new):
            self.used[at.to_numpy()] = True
            return self.tokens.take(at)
        made, held = make(new), len(self.strings)
        at = at.fill_null(-1).to_numpy().copy()
        self.used[at[at >= 0]] = True
        at[at < 0] = np.arange(held, held + len(new))
        every, tokens = pa.concat_arrays([self.strings, new]), pa.concat_arrays([self.tokens, made])
        out = tokens.take(pa.array(at))
        short = pc.less_equal(pc.utf8_length(new), KEPT_LETTERS).to_numpy(zero_copy_only=False)
        stay, used = np.concatenate([np.ones(held, bool), short]), np.concatenate([self.used, np.zeros(len(new), bool)])
        if np.count_nonzero(stay) > most:  # what was used since the last time stays, and of that, and of what is new, the last ones up to a half
            stay[:held] = self.used
            last = np.flatnonzero(stay)[-(most // 2) :] if most > 1 else np.zeros(0, np.int64)
            stay, used = np.zeros(len(stay), bool), np.zeros(len(used), bool)
            stay[last] = True
        if stay.all():
            self.strings, self.tokens, self.used = every, tokens, used
        else:
            self.strings, self.tokens, self.used = every.filter(pa.array(stay)), tokens.filter(pa.array(stay)), used[stay]
        return out


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, pa.int32()))


def _starts(lists: pa.Array) -> np.ndarray:
    """Where each list begins, and the last one ends, among lists.flatten()."""
    at = lists.offsets.to_numpy().astype(np.int64)
    return at - at[0]


def byte_letters() -> list[str]:
    """The printable letter of each byte, as byte-level vocabularies have them: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Tokenizer:
    """A tokenizer file with a BPE model over byte letters and an end-of-word suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"] or spec["decoder"] is not None or steps[1]["use_regex"]:
            raise ValueError(f"unknown layout of {path}")
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {a + b for a, b in merges}
        self.automaton = Automaton([t for t in model["vocab"] if t not in made], merges, self.suffix)
        self.number = [model["vocab"][t] for t in self.automaton.labels]  # outer ids
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any("\n" in x for x in self.special):
            raise ValueError(f"a special token of {path} has a line's end")
        self.token = {i: t for t, i in [*model["vocab"].items(), *self.special.items()]}
        self._special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._wide_special = any(regex.search("[\t-\r ]", x) for x in self.special)
        self._space = regex.compile(f"[{_SPACE.replace('\t-\r', '')}]+")  # ASCII white space is gone by then
        self._words = regex.compile(steps[0]["pattern"]["Regex"].replace(r"\s", _SPACE))
        self._letters = byte_letters()
        self._code = np.array([self.automaton.code[x] for x in self._letters], np.int64)  # of each byte
        self._outer = np.array(self.number, np.int32)
        ids = range(max(self.token) + 1)
        self._id_text = pa.array([f"{i} " for i in ids], pa.large_string())
        self._label_text = pa.array([f"{self.token.get(i, '')} " for i in ids], pa.large_string())
        self.cache_words = CACHE_WORDS
        self.forget()

    def forget(self) -> None:
        """Lets go of the words kept so far; the automaton stays."""
        self._known, self._stretches = _Kept(), _Kept()

    def _pieces(self, text: str) -> list[str]:
        """Stretches without ASCII white space, for tokenizers of which a special token has some: those are stretches too."""
        return [y for i, x in enumerate(self._special.split(text)) for y in ([x] if i % 2 else regex.split("[\t-\r ]+", x))]

    def _cut(self, stretches: list[str]) -> list[str]:
        """Normalised and pre-split words of all stretches, with a line's end after those of each. A special token has a line's end before it, which no word has."""
        text = "\n".join([*stretches, ""])
        out, find = [], self._words.findall
        for i, part in enumerate(self._special.split(text) if self._special is not None else [text]):
            if i % 2:
                out.append("\n" + part)
                continue
            if not part.isascii():
                part = self._space.sub(" ", unicodedata.normalize("NFC", part).replace("Σ", "σ"))
            for j, x in enumerate(part.lower().split("\n")):
                if j:
                    out.append("\n")
                out += find(x)
        return out

    def _encode_words(self, words: pa.Array) -> pa.Array:
        """Token lists of distinct words."""
        upto = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        code = self._code[np.frombuffer(words.buffers()[2], np.uint8)[upto[0] : upto[-1]]]
        long, upto, lo, tokens, counts = pc.utf8_length(words).to_numpy() > LONG_WORD, upto - upto[0], 0, [], []
        while lo < len(words):
            if long[lo]:
                hi = lo + 1
                found = np.array(self.automaton.encode("".join([self._letters[b] for b in words[lo].as_py().encode()])), np.int64)
                n = np.array([len(found)])
            else:
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + STEP_LETTERS, side="right")) - 1)
                hi = lo + int(np.argmax(long[lo:hi])) if long[lo:hi].any() else hi
                found, n = self.automaton.encode_words(code[upto[lo] : upto[hi]], upto[lo : hi + 1] - upto[lo])
            tokens.append(self._outer[found])
            counts.append(n)
            lo = hi
        return _lists(np.concatenate(tokens), np.concatenate(counts))

    def _encode_any(self, words: pa.Array) -> pa.Array:
        """Token lists of distinct words, special tokens and line's ends (which have none)."""
        plain = pc.invert(pc.starts_with(words, "\n"))
        made = self._known.get(words.filter(plain), self._encode_words, self.cache_words)
        if len(made) == len(words):
            return made
        odd = words.filter(pc.invert(plain)).to_pylist()
        odd_lists = pa.array([[self.special[w[1:]]] if len(w) > 1 else [] for w in odd], pa.list_(pa.int32()))
        plain = plain.to_numpy(zero_copy_only=False)
        at = np.where(plain, np.cumsum(plain) - 1, len(made) + np.cumsum(~plain) - 1)
        return pa.concat_arrays([made, odd_lists]).take(pa.array(at))

    def _encode_stretches(self, stretches: pa.Array) -> pa.Array:
        """Token lists of distinct stretches of text without ASCII white space."""
        coded = pa.array(self._cut(stretches.to_pylist()), pa.string()).dictionary_encode()
        ends = np.flatnonzero(pc.equal(coded.dictionary, "\n").to_numpy(zero_copy_only=False)[coded.indices.to_numpy()])
        lists = self._encode_any(coded.dictionary).take(coded.indices)
        upto = _starts(lists)[ends]
        return _lists(lists.flatten().to_numpy(), np.diff(upto, prepend=0))

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Of a column of texts without nulls: where each one's stretches begin, which stretch stands at each place, and the token lists of those stretches. No word crosses white space and no normalisation does, so stretches without ASCII white space are handled, and kept, alone."""
        cut = pa.array([self._pieces(x) for x in texts.to_pylist()], pa.list_(pa.string())) if self._wide_special else pc.ascii_split_whitespace(texts)
        coded = cut.flatten().dictionary_encode()
        return _starts(cut), coded.indices, self._stretches.get(coded.dictionary, self._encode_stretches, self.cache_words)

    def joined(self, stretches: np.ndarray, which: pa.Array, lists: pa.Array, labels: bool = False) -> Iterator[memoryview]:
        """The ids or labels of each text, joined by a space, in UTF-8."""
        text = (self._label_text if labels else self._id_text).take(lists.flatten())
        upto = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1)[_starts(lists)]
        every = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(upto), text.buffers()[2]).take(which)
        upto = np.frombuffer(every.buffers()[1], np.int64, len(every) + 1)[stretches].tolist()
        data = memoryview(every.buffers()[2] or b"")
        for a, b in zip(upto[:-1], upto[1:], strict=True):
            yield data[a : max(a, b - 1)]

    def batch(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(ids joined by a space, decoded text) of each text."""
        found = self.encoded(pa.array(texts, pa.string()))
        for ids, decoded in zip(self.joined(*found), self.joined(*found, labels=True), strict=True):
            yield str(ids, "utf-8"), str(decoded, "utf-8")

    def texts(self, text: str) -> tuple[str, str]:
        return list(self.batch([text]))[0]

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.texts(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.token[i] for i in ids if i in self.token)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def tokenizer(path: str) -> Tokenizer:
    """One automaton for each worker process and file."""
    return Tokenizer(path)


def tokenize(docs: DataFrame, path: str | None = None, ids: bool = True, words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, input_ids. The file lies at the same path on every executor. words: entries of a worker's tables; fewer take less memory and more time."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        tok.cache_words = words
        for batch in batches:  # the words of the tables stay from task to task
            sizes, lo = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy().astype(np.int64)), 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + BATCH_BYTES, side="right")))
                yield encoded(tok, batch.slice(lo, hi - lo))
                lo = hi

    def encoded(tok: Tokenizer, part: pa.RecordBatch) -> pa.RecordBatch:
        stretches, which, lists = tok.encoded(part.column("text").cast(pa.string()).fill_null(""))
        upto = np.concatenate([[0], np.cumsum(np.diff(_starts(lists))[which.to_numpy()])])[stretches]
        shas, decoded = ([hashlib.sha256(x).hexdigest() for x in tok.joined(stretches, which, lists, labels)] for labels in (False, True))
        columns = [part.column("doc_id"), pa.array(np.diff(upto), pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if ids:
            columns.append(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), lists.take(which).flatten()))
            names.append("input_ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(tk.released(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", input_ids array<int>" * ids)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(tk.table(spark, sf_dir, "documents"), ids=False)
