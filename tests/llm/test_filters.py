"""URL rules, the quality ledger, personal data and mixing: edge cases, and plain versions to compare with."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from foldsmith.llm import mixing as M
from foldsmith.llm import personal as P
from foldsmith.llm import quality_ledger as Q
from foldsmith.llm import toxicity as T
from foldsmith.llm import url_filter as U
from foldsmith.llm.queries_filters import URL_RULES

def rules(spark, rows=URL_RULES):
    return spark.createDataFrame(rows, "rule string, verdict string")


URLS = ["http://a.example.com/en/71?q", "HTTPS://EXAMPLE.COM/en/8", "x://net/de/1", "x://example.net/de/8#a", None, "", "no scheme",
        "x://badcom/en/1", "x://com/en/", "x://org/es", "x://a.org/es/", "x://Ünet/de/", "x://", "x://net?/de/", "x://m.net/de/"]


def plain_verdict(url, table):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(r), r, v) for r, v in table for h, p in [U.split_rule(r)]
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, "allow")))


@pytest.mark.parametrize("limit", [U.MAX_INDEX_BYTES, 0])
def test_url_rules_agree_with_plain_search(spark, limit):
    pages = spark.createDataFrame([(k if k else None, u, 1, "x") for k, u in enumerate(URLS + URLS[:3])],
                                  "page_id bigint, url string, rule int, verdict string")
    got = Counter(tuple(r) for r in U.judge_urls(pages, rules(spark), max_index_bytes=limit).collect())
    assert got == Counter((k if k else None, *plain_verdict(u, URL_RULES)) for k, u in enumerate(URLS + URLS[:3]))
    assert U.judge_urls(pages.limit(0), rules(spark), max_index_bytes=limit).count() == 0


def test_no_rules_and_contradicting_rules(spark):
    pages = spark.createDataFrame([(1, "x://a/b")], "page_id bigint, url string")
    assert U.judge_urls(pages, rules(spark, []).limit(0)).first().verdict == "allow"
    both = rules(spark, [("a/", "allow"), ("a/", "block"), (None, "block"), ("a/b", None)])
    assert U.judge_urls(pages, both).first().verdict == "block"


def test_equal_digests_are_told_apart_by_their_strings():
    index = U.build_index([("a.com/", "block"), ("b.com/", "allow")])
    index["keys"][:] = index["keys"][0]  # as if both collided
    import xxhash
    asked = [t for t in ("a.com", "b.com") if xxhash.xxh64_intdigest(t + "/") == index["keys"][0]]
    assert len(asked) == 1
    rule, verdict = U.probe(index, asked, ["/"])
    assert rule == [asked[0] + "/"] and verdict == ["block" if asked == ["a.com"] else "allow"]


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if grams[tuple(words[i:i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def test_ledger_agrees_with_plain_counts(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("a b cé d|# e").strip() for _ in range(rnd.randrange(60))) + rnd.choice(["", "\n\n a\x1c\n a\x1c"])
             for _ in range(60)] + [None, "", " \n\t", "x" * 50_000, "w " * 30_000, "a\u00a0b\u2003c"]
    docs = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id bigint, text string, n_words string")
    ledger = Q.build_ledger(docs)
    got = {r.doc_id: tuple(r[m] for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
           for r in ledger.collect()}
    assert got == {k: plain_measures(t or "") for k, t in enumerate(texts)}
    assert Q.build_ledger(docs.limit(0)).count() == 0
    rows = ledger.collect()
    mask = Q.policy_mask("v1")
    for r in Q.ablation(ledger, "v1").collect():
        bit = 1 << [n for n, _ in Q._rules()].index(r.rule)
        assert r.failed == sum(bool(x.failures & bit) for x in rows)
        assert r.only == sum(x.failures & mask == bit for x in rows)
        assert r.kept_without == sum(not x.failures & mask & ~bit for x in rows)


def naive_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([ -]?[0-9])+", text):
        d = re.sub(r"[ -]", "", m[0])
        out += [("card", *m.span())] * (13 <= len(d) <= 19 and P.luhn(d))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text)
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_agree_with_plain_patterns():
    rnd = random.Random(2)
    for _ in range(4000):
        text = "".join(rnd.choice("0123459.@+-() a%_=Z\né") for _ in range(rnd.randrange(60)))
        assert P.base_spans(text) == naive_base(text), text
    assert P.base_spans("a" * 300_000 + "@" + "1." * 20_000)[:1] == [("email", 0, 300_000 + 1 + 39_999)]
    assert P.base_spans("a" * 300_000 + "9" * 300_000) == []


def test_decoding_is_the_best_of_all_segmentations():
    rnd = np.random.default_rng(3)
    text = "a 1.2 @b"
    tokens = P.windows(text)[0]
    for _ in range(20):
        weights = rnd.normal(size=(len(P.KINDS), P.N_FEATURES))
        found = list(P.segments(text, tokens))

        def every(i):
            yield 0.0, [] if i >= len(tokens) else []
            for a, b, f in found:
                if a >= i:
                    for y in range(len(P.KINDS)):
                        for s, rest in every(b):
                            yield s + weights[y, f].sum(), [(P.KINDS[y], tokens[a][0], tokens[b - 1][1]), *rest]

        best = max(every(0), key=lambda x: x[0])
        assert P.decode(text, tokens, weights) == best[1]


def test_trained_field_finds_kinds_and_leaves_prose_alone(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8)))
    kinds = [lambda: f"{word()}.{rnd.randint(1, 99)}@mail{rnd.randint(0, 9)}.example.com", lambda: ".".join(str(rnd.randint(1, 255)) for _ in range(4)),
             lambda: "4111111111111111", lambda: f"+1 ({rnd.randint(100, 999)}) 555-{rnd.randint(1000, 9999)}",
             lambda: 'token = "%040x"' % rnd.getrandbits(160), lambda: str(rnd.randint(1900, 2030)), lambda: "4111111111111112"]
    texts = [" ".join([*(word() for _ in range(20)), kinds[k % 7](), *(word() for _ in range(20))]) for k in range(280)]
    weights = P.train(texts)
    assert [k for k, _, _ in P.find_spans('x y z token = "%040x" ok' % rnd.getrandbits(160), weights)[1]] == ["secret"]
    # the base drops two cards that stand side by side; the field tells them apart
    base, added = P.find_spans("a b 4111111111111111 5500005555555559 c d", weights)
    assert base == [] and added == [("card", 4, 20), ("card", 21, 37)]
    assert P.find_spans("in 1999 we had 12 of 3.5 and 4111111111111112 ok", weights) == ([], [])
    docs = spark.createDataFrame([(1, None, 5), (None, "", 6), (3, texts[0], 7), (3, texts[0], 7)],
                                 "doc_id bigint, text string, spans int")
    rows = P.detect(docs, weights).collect()
    assert sorted(len(r.spans) for r in rows) == [0, 0, 1, 1]
    masked = {(r.doc_id, r.text, r.spans) for r in P.mask(docs, weights).collect()}
    assert (1, None, 5) in masked and (None, "", 6) in masked
    assert any("<EMAIL>" in (t or "") for _, t, _ in masked)
    assert P.detect(docs.limit(0), weights).count() == 0 and P.fit(docs.limit(0)).shape == weights.shape


def test_mix_meets_targets_and_reruns_agree(spark):
    rnd = random.Random(5)
    rows = [(k, " ".join("w" * 3 for _ in range(rnd.randint(0, 60))), rnd.choice(["b", "a", "a", "a", None, ""]), "x")
            for k in range(900)]
    rows += [(None, None, "a", "x"), (7, rows[7][1], rows[7][2], "x"), (10_000, "w", "tiny", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string")
    got = M.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        assert 0 <= r.copies <= 2 and r.source_size == sum(len((t or "").split()) for _, t, s, _ in rows if s == r.source)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, capped = {}, set()
    while True:  # reshare until none is above
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        want = {s: 2 * sizes[s] if s in capped else rest * weight[s] / free for s in order}
        over = {s for s in order if s not in capped and want[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    assert target == pytest.approx(want)
    for s in order:
        assert abs(taken[s] - target[s]) <= 60
    again = Counter(tuple(r) for r in M.mix(docs.repartition(5)).collect())
    assert again == Counter(tuple(r) for r in got)
    repeated = M.repeat(docs)
    assert repeated.columns == docs.columns
    assert Counter(r.doc_id for r in repeated.collect()) == sum((Counter({r.doc_id: r.copies}) for r in got), Counter())
    assert M.mix(docs.limit(0)).count() == 0


def plain_rates(docs, target, most=2.0):
    """Expected copies in proportion to weight, none above ``most``, that make up the target: full ones set aside by turns."""
    full = set()
    while True:
        rest = target - most * sum(docs[i][0] for i in full)
        rate = rest / sum(n * w for i, (n, w) in enumerate(docs) if i not in full)
        over = {i for i, (_, w) in enumerate(docs) if i not in full and rate * w > most}
        if not over:
            return [most if i in full else rate * w for i, (_, w) in enumerate(docs)]
        full |= over


@pytest.mark.parametrize("share", [0.4, 1.3])
def test_documents_are_included_as_often_as_their_odds_say(spark, share):
    rnd = random.Random(11)
    shape = [(rnd.choice([1, 3, 9, 40, 130]), rnd.choice([0.5, 1.0, 2.0, 7.0])) for _ in range(40)]
    sources = 300  # each a draw of its own of the same documents
    rows = [(s * 40 + i, " ".join(["w"] * n), f"s{s:03d}", w, "own") for s in range(sources) for i, (n, w) in enumerate(shape)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, odds double, u string")
    for column, weights in (("odds", [w for _, w in shape]), (None, [len(bin(n)) - 2 for n, _ in shape])):
        got = M.mix(docs, weights=(1,), share=share, weight_col=column).collect()
        want = plain_rates([(n, w) for (n, _), w in zip(shape, weights)], share * sum(n for n, _ in shape))
        assert len({round(x % 1, 6) for x in want}) > 2  # unequal odds
        mean, taken = [0.0] * 40, Counter()
        for r in got:
            assert int(want[r.doc_id % 40] + 1e-9) <= r.copies <= -int(-want[r.doc_id % 40] // 1)
            mean[r.doc_id % 40] += r.copies / sources
            taken[r.source] += r.copies * r.size
        assert all(abs(taken[s] - share * sum(n for n, _ in shape)) <= 65 for s in taken)
        assert max(abs(a - b) for a, b in zip(mean, want)) < 0.13


def test_mix_weights_that_say_nothing(spark):
    rows = [(1, "a b", "s", None), (2, "a b", "s", -1.0), (3, "a b", "s", float("nan")), (4, "a b", "s", float("inf")),
            (5, "a b", "s", 1.0), (6, "", "t", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, odds double")
    assert {r.doc_id: r.copies for r in M.mix(docs, weight_col="odds").collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 2, 6: 0}


def test_toxicity_on_held_out_rows_and_misspellings(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice(["an", "the", "re", "on", "ti", "es"]) for _ in range(rnd.randint(1, 4)))
    rows = []
    for k in range(600):
        words = [word() for _ in range(rnd.randint(5, 150))]
        bad = k % 3 == 0
        if bad:
            for _ in range(max(1, len(words) // 40)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["Idiot,", "worthless", "SCUM!"]))
        rows.append((k, " ".join(words), int(bad), 9))
    docs = spark.createDataFrame([(k, t, s) for k, t, _, s in rows] + [(None, None, 1), (9999, "", 1)],
                                 "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(k, y) for k, _, y, _ in rows] + [(None, 1), (1, None)], "doc_id bigint, toxic int")
    model = T.fit(docs, labels)
    scored = T.score(docs, model).collect()
    held = [(r.doc_id, r.score) for r in scored if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum((s >= 0.5) == (k % 3 == 0) for k, s in held)
    assert right / len(held) > 0.8  # a few hundred short texts; the tables below have enough to learn from
    assert all(0 <= r.score <= 1 for r in scored) and all(r.score < 0.5 for r in scored if not r.text)
    scorer = T.Scorer(model)
    assert scorer.word(b"worthles") > 3 * scorer.word(b"theonre")
    assert T.score(docs.limit(0), model).count() == 0
    assert T.Scorer(T.train([b"a b"], [1])).score(b"a b") < 0.5


def test_runs_without_spaces_are_scored_whole():
    rnd = random.Random(3)
    signs = [chr(0x4E00 + k) for k in range(12)]
    texts = []
    for k in range(900):
        run = [rnd.choice(signs) for _ in range(rnd.randint(60, 120))]
        if k % 2:
            run.insert(rnd.randrange(25, len(run)), "笨蛋滚")  # past the first 64 bytes
        texts.append("".join(run).encode())
    scorer = T.Scorer(T.train(texts[:675], [k % 2 for k in range(675)]))
    assert sum((scorer.score(t) >= 0.5) == bool(k % 2) for k, t in enumerate(texts) if k >= 675) >= 0.8 * 225
    for run in (texts[0], b"a" * 65, "aé😀語".encode() * 50, bytes(range(128, 256)) * 3):
        parts = T.pieces(run)
        assert max(map(len, parts)) <= T.PIECE and run.startswith(parts[0]) and run.endswith(parts[-1])
        assert {run[i:i + 5] for i in range(len(run) - 4)} == {p[i:i + 5] for p in parts for i in range(len(p) - 4)}
    assert all(p.decode() for p in T.pieces("aé😀語".encode() * 50))


def test_toxicity_on_the_tables(spark):  # some 360 toxic texts to learn from, in four languages
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = labels.filter(T.crc_fold("doc_id") == 0).select("doc_id", "toxic")
    scored = T.score(docs.join(held, "doc_id"), T.fit(docs, labels)).collect()
    right = Counter((r.toxic, int(r.score >= 0.5)) for r in scored)
    assert right[(1, 1)] >= 0.6 * (right[(1, 1)] + right[(1, 0)])
    assert right[(0, 0)] >= 0.95 * (right[(0, 0)] + right[(0, 1)])


def test_segments_of_a_table_of_numbers_are_walked_in_bounded_memory():
    import random
    import tracemalloc

    from foldsmith.llm import personal as P

    rnd = random.Random(1)
    weights = np.zeros((len(P.KINDS), P.N_FEATURES))
    peaks = []
    for lines in (60, 480):
        text = "\n".join(" ".join(str(rnd.randrange(10 ** rnd.randrange(1, 9))) for _ in range(10)) for _ in range(lines))
        tracemalloc.start()
        P.decode(text, P.windows(text)[0], weights)
        peaks.append(tracemalloc.get_traced_memory()[1] / len(text))
        tracemalloc.stop()
    assert peaks[1] < 60 and peaks[1] < 1.5 * peaks[0]  # bytes a character, so 6 MB take some 360 MB
