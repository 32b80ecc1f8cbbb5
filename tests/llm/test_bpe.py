import hashlib
import random

import pytest

from chronoweave.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts(n=300):
    rng = random.Random(3)
    pieces = ["the ", "ing", "  ", "\n", "\t", "don't", "I'LL", "123", "4567", "é", "漢字", "🙂", " ", "‍", "<|endoftext|>", "aaaa", "=====", "\x00", "�", "ÿ", "http://x.y/?z=1", " \n ", "Straße"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_same_codes_and_text_as_the_library(library):
    coder = bpe.BytePairCoder(PATH)
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        assert coder.encode(t) == want, t
        assert coder.decode(want) == library.decode(want, skip_special_tokens=False)


def test_any_codes_decode_as_in_the_library(library):
    coder, rng = bpe.BytePairCoder(PATH), random.Random(4)
    for _ in range(100):
        ids = [rng.randrange(50_000) for _ in range(20)]
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_automaton_against_merging_by_rank():
    """A small vocabulary over two letters, every word up to nine letters, against merges applied in order of rank."""
    rng = random.Random(1)
    labels, merges = [b"a", b"b"], []
    while len(labels) < 14:
        u, v = rng.randrange(len(labels)), rng.randrange(len(labels))
        if labels[u] + labels[v] not in labels:
            merges.append((u, v, len(labels)))
            labels.append(labels[u] + labels[v])
    automaton = bpe.MergeAutomaton(labels, merges)

    def by_rank(word):
        out = [0 if c == 97 else 1 for c in word]
        for u, v, w in merges:
            i = 0
            while i < len(out) - 1:
                if out[i] == u and out[i + 1] == v:
                    out[i : i + 2] = [w]
                i += 1
        return out

    for n in range(1, 10):
        for k in range(2**n):
            word = bytes(97 + (k >> i & 1) for i in range(n))
            assert automaton.encode_word(word) == by_rank(word)
            assert automaton.decode(by_rank(word)) == word


def test_round_trip_of_edges(edge_docs, edge_rows, library, no_docs):
    got = {r["doc_id"]: r for r in bpe.round_trip(edge_docs, PATH).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in edge_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
        assert got[i]["lossless"]
    assert bpe.round_trip(no_docs, PATH).count() == 0


def test_encode_then_decode_and_repeated_rows(edge_docs, edge_rows):
    twice = edge_docs.union(edge_docs)
    back = bpe.decode(bpe.encode(twice, PATH), PATH).collect()
    assert sorted((r["doc_id"], r["text"]) for r in back) == sorted((i, t or "") for i, t in edge_rows * 2)


def test_caches_may_overflow(monkeypatch, library):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    monkeypatch.setattr(bpe, "KEPT_ARCS", 5)
    coder = bpe.BytePairCoder(PATH)
    for t in texts(40):
        assert coder.encode(t) == library.encode(t, add_special_tokens=False).ids
        assert "".join(x[0] + "," for x in coder.parts(t)) == "".join(f"{i}," for i in coder.encode(t))
        assert len(coder.words.kept) <= 3 and len(coder.codes.older) <= 3
