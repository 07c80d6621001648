"""The encoding automaton against plain merging and the tokenizers library."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from foldsmith.llm import bpe_automaton as B
from foldsmith.llm.queries_packing import TOKENIZER


def merged(word, merges):
    """Plain encoding: the earliest merge that applies, leftmost first, until none does."""
    rank = {(u, v): (k, w) for k, (u, v, w) in enumerate(merges)}
    ids = list(word)
    while True:
        todo = [(rank[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in rank]
        if not todo:
            return ids
        _, k = min(todo)
        ids[k:k + 2] = [rank[ids[k], ids[k + 1]][1]]


@pytest.mark.parametrize("seed", range(30))
def test_automaton_equals_plain_merging_on_all_short_words(seed):
    rnd = random.Random(seed)
    letters = b"ab" if seed % 2 else b"abc"
    labels, merges = {b: bytes([b]) for b in letters}, []
    while len(merges) < 12:
        u, v = rnd.choice(list(labels)), rnd.choice(list(labels))
        if labels[u] + labels[v] not in labels.values():
            merges.append((u, v, 200 + len(merges)))
            labels[merges[-1][2]] = labels[u] + labels[v]
        elif rnd.random() < 0.01:
            break
    automaton = B.Automaton(labels, merges)
    for length in range(1, 9 if len(letters) == 2 else 7):
        for word in map(bytes, itertools.product(letters, repeat=length)):
            assert automaton.read(word) == merged(word, merges), (word, merges)


def test_one_path_spells_each_word():
    labels = {97: b"a", 98: b"b", 1: b"ab", 2: b"aa", 3: b"aba"}
    automaton = B.Automaton(labels, [(97, 98, 1), (97, 97, 2), (1, 97, 3)])
    for length in range(1, 8):
        for word in map(bytes, itertools.product(b"ab", repeat=length)):
            paths, todo = [], [()]
            while todo:
                path = todo.pop()
                made = b"".join(labels[i] for i in path)
                if made == word:
                    paths.append(list(path))
                todo += [(*path, i) for i in automaton.whole.values() if word.startswith(made + labels[i])
                         and (not path or automaton.arc(path[-1], i))]
            assert paths == [automaton.read(word)]


def test_two_merges_into_one_token_are_refused():
    with pytest.raises(ValueError):
        B.Automaton({97: b"a", 1: b"aa", 2: b"aaa"}, [(97, 97, 1), (1, 97, 2), (97, 1, 2)])


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def test_codec_equals_the_library(library):
    codec, rnd = B.load_codec(TOKENIZER), random.Random(3)
    texts = ["".join(rnd.choice("aé1 \n\t'sS²½字😀 ‍<|endoftext|>_-͸\U0001e6c0\x1c\x85") for _ in range(rnd.randint(0, 40)))
             for _ in range(400)]
    texts += ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "\x00", "\U0010ffff", "it's we'LL 'd"]
    texts += ["".join(chr(c) for c in range(lo, lo + 4000) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x30000, 4000)]
    for text in texts:
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == text
    odd = [[rnd.randrange(50_300) for _ in range(6)] for _ in range(200)]  # broken UTF-8, ids without a token
    for ids in odd:
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", [" " * 1_000_000, "x" * 100_000, "ab" * 50_000, "你好" * 50_000, " " * 300_000 + "a" + "\n" * 300_000 + "b"])
def test_very_long_words(library, text):
    assert np.frombuffer(B.load_codec(TOKENIZER).encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_tables_of_texts(spark, library):
    rnd = random.Random(4)
    texts = [None, "", "  x\n\n y\t z", "a<|endoftext|>b", "é😀" * 500, "w " * 30_000]
    texts += ["".join(rnd.choice(["the", " anth", "ré", "42", "!", " "]) for _ in range(rnd.randint(0, 500))) for _ in range(60)]
    rows = [(k if k != 9 else None, t, "x", "y") for k, t in enumerate(texts)] + [(20, texts[20], "x", "y")] * 5
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, id string")
    want = sorted(((k, tuple(library.encode(t or "", add_special_tokens=False).ids)) for k, t, *_ in rows), key=str)
    arrays = B.encode(docs, TOKENIZER)
    assert sorted(((r.doc_id, tuple(r.ids)) for r in arrays.collect()), key=str) == want
    packed = B.encode(docs, TOKENIZER, packed=True)
    assert sorted(((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in packed.collect()), key=str) == want
    for encoded in (arrays, packed):
        assert sorted(((r.doc_id, r.text) for r in B.decode(encoded, TOKENIZER).collect()), key=str) == sorted(
            ((k, t or "") for k, t, *_ in rows), key=str)
    assert B.decode(B.encode(docs.limit(0), TOKENIZER), TOKENIZER).count() == 0
    assert B.decode(spark.createDataFrame([(None,)], "ids array<int>"), TOKENIZER).first().text is None


def test_query(spark, library):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in entry.queries()["op13_bpe_automaton"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert tuple(got[d.doc_id])[1:] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                                            hashlib.sha256(text.encode()).hexdigest())
