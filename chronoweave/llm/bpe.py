"""Byte-pair encoding with a merge automaton.

``MergeAutomaton`` is the deterministic automaton over tokens that accepts a token sequence if and only if it is the
sequence BPE makes of its own bytes. It starts with one state per byte in which every byte may follow. Each merge
``u v -> w`` adds a gadget, in rank order:

* a state for ``w`` whose arcs are those that the state of ``v`` has at that time;
* an arc labelled ``w`` next to each arc labelled ``u``;
* the arc ``v`` of the state of ``u`` goes away.

A gadget copies one row and one column of the transition table. The copies are kept as the two links ``left`` and
``right`` and the time of the merge; an entry of the table is resolved through them once and then kept, so the
automaton of 50k merges takes a few MB and not 50k x 50k entries.

Over bytes this automaton is made deterministic by the subset construction: a state holds, for each place where a
label may still be going on, the token before it and the bytes of it so far. Of every beginning of a word there is just
one accepted path, so each state also names that path's last token. States and transitions are made the first time a
word needs them and kept in a table. A word is encoded by one table look-up a byte, with no way back; its codes are read
off from the last byte. Decoding emits the byte labels of the arcs.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import json
from array import array
from collections.abc import Callable

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped_texts, utf8

#: Words kept with their codes in each Python worker; twice as many at most.
KEPT_WORDS = 250_000
#: Entries of the pair table and states over bytes that are kept; a full table is begun anew.
KEPT_ARCS, KEPT_STATES = 250_000, 200_000
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Of a word: its codes as text, their number, the bytes they decode to.
Word = tuple[str, int, bytes]


class MergeAutomaton:
    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]):
        """labels: bytes of each token, in order of id. merges: (left, right, result) in rank order."""
        n = len(labels)
        self.labels, self.ids = labels, {}
        self.left, self.right, self.time = list(range(n)), list(range(n)), [0] * n
        self.gone: dict[tuple[int, int], int] = {}
        made = {t for t, label in enumerate(labels) if len(label) == 1}
        for k, (u, v, w) in enumerate(merges, 1):
            if u not in made or v not in made or not self._resolve(u, v):
                continue  # earlier merges have taken this arc away, so no word ever gets here
            self.gone[u, v] = k  # the arc v of the state of u goes away at this time
            if w not in made:
                made.add(w)
                self.left[w], self.right[w], self.time[w] = u, v, k
        for t, label in enumerate(labels):
            if label and t in made:
                self.ids.setdefault(label, t)
        # the labels as a tree: (node << 8 | byte) -> node; the root is 0. token: the label that ends at a node, or -1
        self.child: dict[int, int] = {}
        self.token, inner = [-1], {0}
        for label, t in self.ids.items():
            node = 0
            for byte in label:
                key, at = node << 8 | byte, node
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
                    inner.add(at)
            self.token[node] = t
        self.inner = bytearray(len(self.token))
        for node in inner:
            self.inner[node] = 1
        self.length = [len(label) for label in labels]
        self._forget()
        self.size = n
        self.arcs: dict[int, bool] = {}  # by first token * size + second token

    def arc(self, t1: int, t2: int) -> bool:
        """Whether the state of token t1 has an arc t2."""
        key = t1 * self.size + t2
        got = self.arcs.get(key)
        if got is None:
            if len(self.arcs) >= KEPT_ARCS:
                self.arcs.clear()
            got = self.arcs[key] = self._resolve(t1, t2)
        return got

    def _resolve(self, t1: int, t2: int) -> bool:
        gone, time, left, right = self.gone.get, self.time, self.left, self.right
        limit = 1 << 60  # the time up to which the entry must have lived
        while True:
            k = gone((t1, t2))
            if k is not None and k < limit:
                return False
            a, b = time[t1], time[t2]
            if not a and not b:
                return True
            if a > b:
                limit, t1 = a, right[t1]  # the row was copied from that of the right part at time a
            else:  # the column was copied from that of the left part; a merge of equal parts takes the leftmost first
                limit, t2 = b + 1, left[t2]

    def _forget(self) -> None:
        """Only the state before the first byte is left."""
        self.table: dict[int, int] = {}  # (state << 8 | byte) -> state
        self.going: list[tuple[int, ...]] = [(0,)]  # of each state: token before + 1 << 24 | node of the label
        self.last = [-1]
        self.states = {self.going[0]: 0}

    def _step(self, state: int, byte: int) -> int:
        """The transition of a state, made and kept. The label that began first is looked at first."""
        found, going = -1, []
        child, token, inner = self.child.get, self.token, self.inner
        for x in self.going[state]:
            node = child((x & 0xFFFFFF) << 8 | byte)
            if node is None:
                continue
            t = token[node]
            if t >= 0 and found < 0 and (x < 1 << 24 or self.arc((x >> 24) - 1, t)):
                found = t
            if inner[node]:
                going.append(x & ~0xFFFFFF | node)
        if found < 0:
            raise ValueError("a byte without a token")
        going.append(found + 1 << 24)
        key = tuple(going)
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.going)
            self.going.append(key)
            self.last.append(found)
        self.table[state << 8 | byte] = to
        return to

    def encode_word(self, word: bytes) -> list[int]:
        """The labels of the only accepted path over the word: a transition a byte, then the path from its end."""
        if len(self.going) > KEPT_STATES:
            self._forget()
        step, last, ends, state = self.table.get, self.last, [], 0
        for byte in word:
            to = step(state << 8 | byte)
            state = self._step(state, byte) if to is None else to
            ends.append(last[state])
        path, at, length = [], len(word), self.length
        while at:
            t = ends[at - 1]
            path.append(t)
            at -= length[t]
        path.reverse()
        return path

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.labels[t] for t in ids])


class Words:
    """What ``make`` gives for each word, kept in two generations: when the newer one is full, it becomes the older one,
    and the older one goes."""

    def __init__(self, make: Callable[[str], object]):
        self.make, self.kept, self.older = make, {}, {}

    def each(self, words: list[str]) -> list:
        kept, missing = self.kept.get, self._missing
        return [kept(w) or missing(w) for w in words]

    def _missing(self, word: str):
        got = self.older.get(word)
        if got is None:
            got = self.make(word)
            if len(word) > 64:
                return got
        if len(self.kept) >= KEPT_WORDS:
            self.older = dict(self.kept)
            self.kept.clear()
        self.kept[word] = got
        return got


class BytePairCoder:
    """A byte-level BPE tokenizer read from a tokenizers JSON file.

    Texts of any content are allowed: null counts as empty, an added token in a text becomes that token's id, bytes
    that don't form UTF-8 when decoded become U+FFFD."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
        if not pre.get("use_regex", True) or any(a.get(k) for a in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("words are split by the usual pattern, and added tokens stand for themselves alone")
        letters, vocab = byte_letters(), model["vocab"]
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        labels = [b""] * size
        for token, t in vocab.items():
            if all(c in letters for c in token):
                labels[t] = bytes(letters[c] for c in token)
        merges = []
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            merges.append((vocab[a], vocab[b], vocab[a + b]))
        self.automaton = MergeAutomaton(labels, merges)
        for token, t in self.added.items():
            labels[t] = token.encode()
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("|".join(regex.escape(a) for a in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.words, self.codes = Words(self._word), Words(self._codes)

    def _codes(self, word: str) -> bytes:
        return array("i", self.automaton.encode_word(utf8(word))).tobytes()

    def _word(self, word: str) -> Word:
        ids = self.automaton.encode_word(utf8(word))
        return ",".join(map(str, ids)), len(ids), self.automaton.decode(ids)

    def _each(self, text: str | None, words: Words, added: Callable[[str, int], object]) -> list:
        """What ``words`` has of each word of the text, and ``added`` of each added token in it."""
        if not text:
            return []
        if self.split and self.split.search(text):
            out, at = [], 0
            for m in self.split.finditer(text):
                out += words.each(self.pattern.findall(text[at : m.start()]))
                out.append(added(m[0], self.added[m[0]]))
                at = m.end()
            return out + words.each(self.pattern.findall(text[at:]))
        return words.each(self.pattern.findall(text))

    def parts(self, text: str | None) -> list[Word]:
        return self._each(text, self.words, lambda token, t: (str(t), 1, self.automaton.labels[t]))

    def packed(self, text: str | None) -> bytes:
        """The codes as 32-bit integers, one after the other."""
        return b"".join(self._each(text, self.codes, lambda token, t: array("i", [t]).tobytes()))

    def forget(self) -> None:
        """Drop all that is kept, and give the memory back: the worker goes on to other work."""
        self.words, self.codes = Words(self._word), Words(self._codes)
        self.automaton._forget()
        self.automaton.arcs.clear()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        return self.automaton.decode(ids).decode("utf-8", "replace")


_coders: dict[str, BytePairCoder] = {}


def coder(path: str) -> BytePairCoder:
    """One coder for each Python process and file. The vocabulary is read on each executor; it is installed there."""
    if path not in _coders:
        _coders[path] = BytePairCoder(path)
    return _coders[path]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (array of int): the codes of each whole text. Null and empty texts give an empty array."""
    path = path or tokenizer_path()
    kind = df.schema[id_col].dataType.simpleString()

    def run(it):
        import numpy as np
        import pyarrow as pa

        c = coder(path)
        for keys, texts in grouped_texts(it):
            packed = [c.packed(t) for t in texts]
            n = np.array([len(p) // 4 for p in packed], np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n, pa.int64()), ids], [id_col, "n_tokens", "ids"])
        c.forget()

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids array<int>")


def decode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text: the text of each list of codes. A null list gives an empty text, an unknown code an error."""
    path = path or tokenizer_path()
    kind = df.schema[id_col].dataType.simpleString()

    def run(it):
        import pyarrow as pa

        c = coder(path)
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, lossless for each whole text; ids are encoded, then decoded.

    Defined results: null and empty texts have no tokens and the digest of the empty string; equal texts have equal
    rows; other columns of ``df`` are not used, so clashing names do no harm; repeated ids give one row each."""
    path = path or tokenizer_path()
    kind = df.schema[id_col].dataType.simpleString()

    def run(it):
        import pyarrow as pa

        c, sha = coder(path), hashlib.sha256
        for keys, texts in grouped_texts(it):
            n, a, b, same = [], [], [], []
            for t in texts:
                got = c.parts(t)
                n.append(sum([x[1] for x in got]))
                a.append(sha(",".join([x[0] for x in got]).encode()).hexdigest())
                raw = b"".join([x[2] for x in got]).decode("utf-8", "replace").encode()
                b.append(sha(raw).hexdigest())
                same.append(raw == utf8(t))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(same)],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "lossless"],
            )

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return round_trip(table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text")))
