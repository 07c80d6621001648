"""Packing, extraction, archives and the pipeline."""

import io
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from foldsmith.llm import packing as K
from foldsmith.llm import site_tree as S
from foldsmith.llm import warc as W
from foldsmith.llm.queries_packing import TOKENIZER


def filled(runs):
    bins = defaultdict(list)
    for r in runs:
        for k in range(r.count):
            bins[r.first + k].append((r.offset, r.length))
    return bins


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity_and_places_every_piece(rule):
    rnd = random.Random(1)
    for limits in (K.Limits(), K.Limits(100, 4, 6000), K.Limits(64, 64, 64 * 64)):
        most = min(limits.tokens, int(limits.attention ** 0.5))
        histogram = {rnd.randint(1, most): rnd.randint(1, 200) for _ in range(40)}
        runs = K.best_fit(histogram, limits, rule)
        bins = filled(runs)
        for items in bins.values():
            items.sort()
            assert [o for o, _ in items] == list(np.cumsum([0, *(n for _, n in items[:-1])]))
            assert sum(n for _, n in items) <= limits.tokens and len(items) <= limits.documents
            assert sum(n * n for _, n in items) <= limits.attention
        assert Counter(n for items in bins.values() for _, n in items) == Counter(histogram)
        ranks = defaultdict(list)
        for r in runs:
            ranks[r.length] += range(r.rank, r.rank + r.count)
        assert all(sorted(v) == list(range(histogram[n])) for n, v in ranks.items())
    assert K.best_fit({}) == []


def test_packed_pieces_restore_every_document(spark):
    rnd = random.Random(2)
    texts = [None, "", "a<|endoftext|>b", "  x\n\n y\t z", "héllo 你好 😀", "w " * 3000, "x" * 5000, "a" * 1023]
    texts += [" ".join(rnd.choice(["the", "anth", "ré", "42", "!"]) for _ in range(rnd.randint(0, 900))) for _ in range(120)]
    rows = [(k if k != 9 else None, t) for k, t in enumerate(texts)] + [(20, texts[20])] * 40
    docs = spark.createDataFrame([(k, t, 3, "p") for k, t in rows], "doc_id bigint, text string, length int, piece string")
    got = K.pack(docs, TOKENIZER, keep_ids=True).collect()
    plain = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for k, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        head = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        cuts = [0, head, *range(head + 1024, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(k, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        items.sort()
        assert [o for o, _ in items] == list(np.cumsum([0, *(n for _, n in items[:-1])]))
        assert sum(n for _, n in items) <= 1024
    assert len(bins) <= max(sum(r.length for r in got) // 1024, sum(r.length > 512 for r in got)) * 1.06
    assert K.pack(docs.limit(0), TOKENIZER).count() == 0


def test_encoder_agrees_with_tokenizers_on_odd_texts():
    encode, plain = K.load_encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    rnd = random.Random(3)
    for _ in range(400):
        text = "".join(rnd.choice("aé1 \n\t'sS²½字😀\u00a0\u200d<|endoftext|>_-") for _ in range(rnd.randint(0, 40)))
        assert encode(text) == plain.encode(text, add_special_tokens=False).ids


PAGE = """<html><body><div class="Top-Menu">m</div><div id=content><h1>T&amp;x</h1><p>a<b>b</b>c<br>d<p>e <i>f</i>
<ul><li>1<li>2</ul><form>q</form><div class="comments"><p>bad</div><script>if(a<b){"</p>"}</script>tail</div>
<footer>f</footer><div style="x">y</div>"""


def test_main_text_of_odd_pages():
    assert S.main_text(PAGE) == "T&x abc d e f 1 2 tail y"
    assert S.main_text("") == S.main_text("<p>") == S.main_text("<!-- a") == S.main_text("<script>x") == ""
    assert S.main_text("plain &lt;text&gt;\n\n&nbsp;x") == "plain <text> x"
    assert S.main_text("<body><main><header><h1>t</h1></header>x<aside>n</aside></main><p>out") == "t x"
    assert S.main_text('<p title="a > b">x</p><p title="open>y') == "x y"
    assert S.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert len(S.main_text("<p>" + "<i" * 30_000)) >= 0


def test_elements_without_end_tag_do_not_cut_the_page():
    assert S.main_text("<p>a<svg viewBox='0 0 1 1'/>b<p>c") == "a b c"
    assert S.main_text("<p>a<svg><path d='M0'/><text>no</text></svg>b<p>c") == "a b c"
    assert S.main_text("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds<math/> here") == "so x=1 holds here"
    for name in ("canvas", "object", "video", "select", "template"):
        assert S.main_text(f"<p>a<{name} id=x><p>b") == "a b"
        assert S.main_text(f"<p>a<{name}>no</{name}>b") == "a b"
        assert S.main_text(f"<p>a<{name}><p>b<{name}>no</{name}>c") == "a b c"
    assert S.main_text("<p>a<title>b") == "a b" and S.main_text("<p>a<style>b<p>c") == "a"
    assert S.main_text("<svg>" * 3000 + "x" + "<path/>" * 3000) == "x"


def test_hints_on_wrappers_do_not_lose_the_article():
    noise = "<div class=sidebar>menu</div>"
    assert S.main_text(f"<div id=page class='has-sidebar'><article><h1>T</h1><p>body</article>{noise}</div>") == "T body"
    assert S.main_text(f"<main class='content no-sidebar'><p>body</p>{noise}</main>") == "body"
    assert S.main_text(f"<article class='post social'><p>body</p></article>{noise}") == "body"
    assert S.main_text(f"<article><div class='post-header'><h1>T</h1></div><p>the long body</p>{noise}</article>") == "T the long body"
    assert S.main_text(f"<div class='widget-area'><p>body of the page</p>{noise}</div>") == "body of the page"
    # cards and comments marked as articles beside the page's text do not replace it
    assert "the long body" in S.main_text("<div><p>the long body</p></div><div class=related><article>card</article></div>")
    assert S.main_text("<article>body</article><div class=comments><article>long comment</article></div>") != ""


def test_entropies_decide_on_hinted_elements(spark):
    rnd = random.Random(5)
    line = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(8))
    rows, want = [], {}
    for k in range(30):
        texts = [line() for _ in range(4)]
        rows.append((k, "http://h.com/", "".join(f"<div class='page-widget'><p>{t}</p></div>" for t in texts)
                     + "<div class=promo><p>Buy now</p></div>"))
        want[k] = " ".join(texts)
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in S.extract(pages).collect()} == want


def test_site_tree_removes_what_a_host_repeats(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows, want = [], {}
    for k in range(60):
        paragraphs = [" ".join(word() for _ in range(8)) for _ in range(4)]
        rows.append((k, f"http://{'hot' if k < 50 else 'few'}.com/{k}", "<body><div class=x1>Read all about us</div><div class=body2>"
                     + "".join(f"<p>{p}</p>" for p in paragraphs) + "<div class=x2>Join the club</div></div></body>"))
        inner = " ".join(paragraphs)
        want[k] = inner
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows] + [(100, None, None, "t", 1), (None, "http://hot.com/", "", "t", 1)],
                                  "page_id bigint, url string, html string, text string, nodes int")
    got = {r.page_id: (r.text, r.n_chars) for r in S.extract(pages).collect()}
    assert all(got[k] == (want[k], len(want[k])) for k in range(60))
    assert got[100] == got[None] == ("", 0)
    copies = spark.createDataFrame([(k, "x://h/", rows[0][2]) for k in range(20)], "page_id bigint, url string, html string")
    assert {want[0] in r.text for r in S.extract(copies).collect()} == {True}  # copies of a page do not lose its text
    assert S.extract(pages.limit(0)).count() == 0


def test_archives_hold_every_record(spark, tmp_path):
    body = "<html><body><nav>menu</nav><p>page %d</p></body></html>"
    rows = [(k, f"http://h/{k}\n x%", body % (k % 150)) for k in range(200)] + [(500, None, None), (501, "u", ""), (502, "u", "é" * 9)]
    rows += [(502, "u", "é" * 9), (None, "v", "é" * 9), (None, "v", "lone")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, first string")
    folder = f"file://{tmp_path}/a"
    assert sum(r.records for r in W.write_archives(pages, folder, archive_bytes=4000).collect()) == len(rows)
    got = W.read_archives(spark, folder).collect()
    best = {}
    for k, _, html in rows:
        if k is not None:
            best[html or ""] = max(best.get(html or "", -1), k)
    want = Counter()
    for k, url, html in rows:
        data, top = (html or "").encode(), best.get(html or "")
        stored = top is None or k == top
        want[(k, url, "response" if stored else "revisit", len(data), W.payload_digest(data), None if stored else top,
              data if stored else None)] += 1
    seen = Counter((r.page_id, r.url, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to,
                    None if r.payload is None else bytes(r.payload)) for r in got)
    assert seen == want
    alone = f"file://{tmp_path}/b"
    W.write_archives(pages, alone, least_bytes=1 << 20).count()
    assert {r.record_type for r in W.read_archives(spark, alone, payload=False).collect()} == {"response"}
    W.write_archives(pages.limit(0), f"file://{tmp_path}/c").count()


def test_archive_format_is_one_frame_per_record_behind_the_dictionary():
    rnd = random.Random(5)
    records = [W.make_record(k, "u", " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(200)).encode(), None, True)
               for k in range(300)]
    out = io.BytesIO()
    writer = W.ArchiveWriter(out)
    for r in records:
        writer.add(r)
    writer.close()
    data = out.getvalue()
    magic, size = struct.unpack_from("<II", data)
    assert magic == W.SKIPPABLE and data[8:12] == b"\x37\xa4\x30\xec"
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size]))
    one = reader.decompressobj()
    assert one.decompress(data[8 + size:]) == records[0]
    assert [r["page_id"] for r in W.read_archive(data)] == list(range(300))
    assert W.train_dictionary([]) is None


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, docs
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, folder).persist()
        assert kept.columns == columns and 0 < kept.count(), name
        if name != "pareto_mix":
            assert kept.count() <= before.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, folder)
    ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
    first = Counter(r.doc_id for r in packed.filter("piece = 0").collect())
    assert first == ids
    assert not [r for r in kept.select("text").collect() if "@mail" in r.text]


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" + " " * 2_000_000 + "b c", "\n" * 5_000_000, "x" + "\t " * 600_000 + "y  z"])
def test_long_white_space_is_encoded_like_any_other(text):
    plain = Tokenizer.from_file(TOKENIZER)
    assert K.load_encoder(TOKENIZER)(text) == plain.encode(text, add_special_tokens=False).ids


def test_white_space_just_below_the_limit_of_the_split():
    for n in (99_999, 100_000, 100_001):
        text = "a" + " " * n + "b" + "c " * 10
        assert K.load_encoder(TOKENIZER)(text) == Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids


def test_long_pages_of_open_elements_take_memory_and_time_in_proportion():
    import time
    import tracemalloc

    took = []
    for n in (20_000, 160_000):
        tracemalloc.start()
        start = time.perf_counter()
        assert S.main_text("<div>x" * n) == " ".join("x" * n)
        took.append((time.perf_counter() - start, tracemalloc.get_traced_memory()[1]))
        tracemalloc.stop()
    assert took[1][1] < 500e6 and took[1][1] < 16 * took[0][1] and took[1][0] < 30 * took[0][0] + 1
    assert S.main_text("<center>" * 20_000 + "<td>a</p></x>" * 20_000).count("a") == 20_000


def test_pipeline_keeps_columns_whatever_they_are_named(spark):
    from foldsmith.llm import mixing, toxicity

    rows = [(k, f"some words number {k} of this text", "en", "s" if k % 3 else None, 30, 0.25, "k", 7, 8) for k in range(60)]
    rows += [(None, None, None, None, None, None, None, None, None)] * 3 + [(5, "", "en", "s", 0, 1.0, "x", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, "
                                       "_key string, _copies int, c0 int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    clean = toxicity.keep_clean(docs, model, limit=2.0)
    assert clean.columns == docs.columns and sorted(map(str, clean.collect())) == sorted(map(str, docs.collect()))
    assert toxicity.keep_clean(docs, model, limit=-1.0).count() == 0
    assert toxicity.keep_clean(docs.limit(0), model).columns == docs.columns
    taken = mixing.repeat(docs)
    assert taken.columns == docs.columns and set(map(str, taken.collect())) <= set(map(str, docs.collect()))
    copies = mixing.mix(docs).agg({"copies": "sum"}).first()[0]
    assert taken.count() == copies > 0 and mixing.repeat(docs.limit(0)).count() == 0


def test_every_stage_takes_nulls_empty_tables_and_extra_columns(spark, tmp_path):
    words = "one two three four five six seven eight nine ten".split()
    rnd = random.Random(8)
    rows = [(k, " ".join(rnd.choice(words) for _ in range(40)), "en", "s", 1, "keep") for k in range(40)]
    rows += [(k + 100, rows[k][1], "en", None, 1, None) for k in range(5)]
    rows += [(None, None, None, None, None, None), (200, "", None, "t", 0, ""), (201, " " * 1_000_000, "en", "t", 1_000_000, "")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"
    spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(40)], "doc_id bigint, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            got = out.collect()
            if name != "best_fit_packing":
                assert out.columns == docs.columns, name
            if name == "ngram_jaccard_join" and docs.count():
                assert {r.doc_id for r in got} == {r[0] for r in rows} - {100, 101, 102, 103, 104}
