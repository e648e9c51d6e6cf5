"""Language, quality, token counts, packing, pages and the pipeline."""

import collections
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetfootprint.llm import catalog, language, mixing, packing, pages, pii, quality, simhash, tokens

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@needs_tables
def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    out = [r for r in catalog.op5_language(spark, SF).collect()]
    held = [r for r in out if r.held_out]
    assert len(out) == len(truth) and np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97


def test_language_cases(docs, no_docs, spark):
    model = language.fit(docs.select("doc_id", "text", F.coalesce("lang", F.lit("en")).alias("lang")))
    out = {r.doc_id: r.found for r in language.identify(docs, model).collect()}
    assert len(model.centroids) and out[80].lang_pred == out[81].lang_pred == out[86].lang_pred == "und" and out[80].rejected
    assert all(0 <= f.score <= 1 for f in out.values())
    empty = language.fit(no_docs)
    assert {r.found.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}
    assert language.identify(no_docs, model).count() == 0


@needs_tables
def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in catalog.op2_quality_classifier(spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([labels[r.doc_id] == r.predicted for r in held]) > 0.95


def test_quality_gradient_and_cases(docs, no_docs, spark):
    rng = np.random.default_rng(1)
    bags = [rng.random((rng.integers(1, 6), quality.FEATURES)).astype("f4") for _ in range(12)]
    labels = np.array([0.0, 1.0] * 6)
    model = quality.train(bags, labels, epochs=1)
    rows, starts = np.concatenate(bags).astype(float), np.cumsum([0, *map(len, bags)])[:-1]

    def loss():
        p = model.forward(rows, starts)["p"]
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    grads = quality._gradient(model, rows, starts, labels)
    for name, at in (("encode", (3, 2)), ("value", (1, 1)), ("gate", (2, 3)), ("attend", (4,)), ("score", (5,)), ("encode_0", (0,))):
        old = model.weights[name][at]
        model.weights[name][at] = old + 1e-6
        up = loss()
        model.weights[name][at] = old - 1e-6
        down = loss()
        model.weights[name][at] = old
        assert abs((up - down) / 2e-6 - grads[name][at]) < 1e-6
    labelled = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.score(docs, quality.fit(docs, labelled)).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert quality.fit(docs, labelled.limit(0)).constant == 0.5
    assert quality.score(no_docs, quality.fit(no_docs, labelled)).count() == 0


def test_prefix_counts(docs, no_docs, texts):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.MODEL))
    out = tokens.prefix_counts(docs).select("doc_id", "n_bytes", tokens.n_tokens(F.col("counts")).alias("n")).collect()
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in texts)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n) for r in out) == want
    assert tokens.prefix_counts(no_docs).count() == 0
    count, rng = tokens.counter().prefixes, random.Random(1)
    signs = "ab  \n\tthe▁éß😀漢字<s>0123 .,!\x00"
    for text in ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(400)] + [" " * 40 + "the", "ha" * 300, "</s><unk>"]:
        assert count(text).tolist() == [len(library.encode(text[:k])) for k in range(len(text) + 1)]


def test_budget(spark):
    frame = spark.createDataFrame([(1, "the quick brown fox " * 50)], "doc_id long, text string")
    chars = tokens.prefix_counts(frame).select(tokens.within(F.col("counts"), 17)).first()[0]
    count = tokens.counter().prefixes("the quick brown fox " * 50)
    assert count[chars] <= 17 and (count[chars + 1 :] > 17).all()


def test_packing_round_trip(docs, no_docs, texts):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    special = [(2000, "end <|endoftext|> of text"), (2001, "<|endoftext|>")]
    frame = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(special, "doc_id long, text string"))
    out = packing.pack(frame, with_ids=True).collect()
    want = sorted((-1 if i is None else i, library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in texts + special)
    whole, pieces = [], {}
    for r in out:
        assert r.length == len(r.ids) and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        pieces.setdefault((-1 if r.doc_id is None else r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    for (doc_id, total), parts in pieces.items():
        times = sum(1 for i, ids in want if i == doc_id and len(ids) == total)
        ids = [x for _, part in sorted(parts)[::times] for x in part]
        whole += [(doc_id, ids)] * times
    assert sorted(whole) == want
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 1024
    assert packing.pack(no_docs).count() == 0
    assert sum(packing.cuts(5000, 1024, 64)) == 5000 and packing.cuts(1024, 1024, 64) == [1024] and packing.cuts(1, 1024, 64) == [1]


PAGE = (
    '<html><head><title>T</title></head><body><header>Site</header><nav><a href="/">Home</a></nav><script>if (a<b) "</p>"</script>'
    '<article class="post"><h1>Head &amp; line</h1><p>One <b>bold</b><br>two<p class="ad">Buy</p><p>Three &lt;x&gt;</p>'
    '<div id="comments"><p>First!</p></div><form>mail</form></article><aside>More</aside><div class="cookie-notice">We use</div><footer>End'
)


def test_pages(spark):
    menu, legal = "<div>Site wide menu with Home News About pages</div>", "<div>All rights are reserved by us since long ago</div>"
    rows = [(1, "http://a.b/1", PAGE), (2, "http://a.b/2", None), (3, None, ""), (4, "http://a.b/3", "plain <b>text"), (None, "http://a.b/1", PAGE)]
    rows += [(10 + i, f"http://Q.c/{i}", f"{menu}<p>Body {i} of page {i * 3} ends in {i + 5}</p>{legal}") for i in range(6)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    for group in (200, 3):
        out = {r.page_id: r.text for r in pages.extract(frame, group_pages=group).collect()}
        assert out[1] == out[None] == "Head & line\nOne bold two\nThree <x>"
        assert out[2] == out[3] == "" and out[4] == "plain text"
        assert [out[10 + i] for i in range(6)] == [f"Body {i} of page {i * 3} ends in {i + 5}" for i in range(6)]
    assert pages.extract(frame.limit(0)).count() == 0


def test_attributes_are_read_as_attributes():
    bad = ['class="ad"', "id='comments'", "class=cookie-notice", 'role="navigation"', "hidden", 'style="display: none"', 'class="site-footer x"']
    good = ['href="/?id=ad&class=menu"', 'class="content has-sidebar"', 'data-class="ad"', 'class="type-post category-social"', 'title="a class=ad here"', ""]
    assert all(pages.is_boilerplate("div", x) for x in bad) and not any(pages.is_boilerplate("div", x) for x in good)
    page = '<div class="wrap with-ads"><article class="post has-comments"><p>See <a href="?id=share">this</a>, x < y</p></article></div>'
    assert pages.blocks(page) == [("article", "See this, x < y")]


def test_repeated_runs_by_brute_force():
    rng = random.Random(6)
    streams = [np.array([rng.randrange(4) for _ in range(rng.randrange(0, 60))], np.uint64) for _ in range(8)]
    got = pages.repeated(streams, np.arange(8), 4, 3)
    where = {}
    for page, s in enumerate(streams):
        for i in range(len(s) - 3):
            where.setdefault(tuple(s[i : i + 4]), set()).add(page)
    for s, mask in zip(streams, got):
        want = [False] * len(s)
        for i in range(len(s) - 3):
            if len(where[tuple(s[i : i + 4])]) >= 3:
                want[i : i + 4] = [True] * 4
        assert mask.tolist() == want


@needs_tables
def test_pages_are_documents(spark):
    plain = lambda t: " ".join(t.split())
    known = {plain(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()}
    out = catalog.op7_page_text(spark, SF).collect()
    assert all(plain(r.text.split("\n", 1)[1]) in known for r in out) and all(r.n_chars == len(r.text) for r in out)


def test_pipeline_stages(spark, docs, texts):
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    found = corpus_pipeline.language_id(spark, base, "")
    model = language.fit(base)
    assert sorted(r.text for r in found.collect()) == sorted(t for _, t in texts if not model.predict(t)[2])
    unique = corpus_pipeline.near_dedup(spark, found.cache(), "")
    codes = [simhash.fingerprint(r.text) for r in unique.collect()]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(codes) for b in codes[:i])
    dropped = {simhash.fingerprint(r.text) for r in found.collect()} - set(codes)
    assert all(any((a ^ b).bit_count() <= 12 for b in codes) for a in dropped)
    masked = corpus_pipeline.personal_data(spark, unique, "")
    assert masked.columns == base.columns and pii.find(masked).filter(F.size("spans") > 0).count() == 0
    mixed = corpus_pipeline.source_mix(spark, masked, "")
    assert mixed.columns == base.columns
    whole = {(r.doc_id, r.text) for r in masked.collect()}
    assert all((r.doc_id, r.text) in whole for r in mixed.collect())
    taken = {r.doc_id: r.taken for r in mixing.assign_positions(masked).collect()}
    # what the mix takes whole is there as often, what it cuts at most once more or less
    times = collections.Counter(r.doc_id for r in mixed.collect())
    words = {r.doc_id: len(r.text.split()) for r in masked.collect() if r.text}
    assert all(abs(times[i] - taken[i] / words[i]) < 1 for i in words if words[i])
    packed = corpus_pipeline.pack(spark, mixed, "")
    encode = packing.byte_bpe()
    assert packed.select(F.sum("length")).first()[0] == sum(len(encode([r.text])[0]) + 1 for r in mixed.collect())


@needs_tables
def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "personal_data", "source_mix", "packing"]
