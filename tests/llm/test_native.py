"""Mixing, quality rules and personal data against plain Python, with plans that stay in the JVM."""

import collections
import hashlib
import re

from pyspark.sql import functions as F

from fleetfootprint.llm import mixing, pii, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def water(sizes):
    """Targets by sharing again and again until none is above its stop."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    open_, target, left = set(names), {}, float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            target.update({s: left * weight[s] / total for s in open_})
            break
        target.update({s: 3.0 * sizes[s] for s in over})
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return target


def test_mix_targets_and_taken(docs):
    out = mixing.assign_positions(docs).collect()
    assert len(out) == docs.count()
    source = {(r.doc_id, r.text): r.source for r in docs.collect()}
    size = lambda t: len(WORD.findall(t or ""))
    sizes = collections.Counter()
    for (_, text), s in source.items():
        sizes[s] += size(text) * sum(1 for r in docs.collect() if (r.doc_id, r.text) == (_, text))
    target, taken = water(sizes), collections.Counter()
    by_size = {}
    for r in docs.collect():
        by_size.setdefault((r.doc_id, size(r.text)), r.source)
    for r in out:
        s = by_size[r.doc_id, r.size]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(o.words for o in r.occurrences)
        assert all(0 <= o.position < 1 for o in r.occurrences)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) < 1 + 1e-6
    again = {tuple(r) for r in mixing.assign_positions(docs.repartition(5)).select("doc_id", "size", "taken").collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in out}


def test_mix_stops_are_shared_again(spark):
    rows = [(1, "a"), (2, "b " * 30), (3, "c " * 100), (4, "d"), (5, "e " * 400)]
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in rows], "doc_id long, text string, source string")
    want = water({f"s{i}": len(t.split()) for i, t in rows})
    for r in mixing.assign_positions(docs).collect():
        assert abs(r.target - want[f"s{r.doc_id}"]) < 1e-9


def test_demand_is_inverted(spark):
    for knots in mixing.SCHEDULES:
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))

        def demand(t):
            done = 0.0
            for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
                end = min(t, t1)
                if end > t0:
                    done += (end - t0) * (w0 + w0 + (w1 - w0) * (end - t0) / (t1 - t0)) / 2
            return done / area

        shares = [i / 20 for i in range(20)]
        frame = spark.createDataFrame([(s,) for s in shares], "share double")
        for r in frame.select("share", mixing.inverse_demand(F.col("share"), knots).alias("t")).collect():
            assert abs(demand(r.t) - r.share) < 1e-9


def test_mix_order_and_documents(docs, no_docs):
    assigned = mixing.assign_positions(docs)
    order = [r.position for r in mixing.training_order(assigned).collect()]
    assert order == sorted(order)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    # every text is one of the input's, whole, and a source's words miss its target by half of its longest document at most
    rows = [r.asDict() for r in docs.collect()]
    known = {(r["doc_id"], r["text"], r["n_chars"]) for r in rows}
    size = lambda t: len(WORD.findall(t or ""))
    sizes, longest, words = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r["source"]] += size(r["text"])
        longest[r["source"]] = max(longest[r["source"]], size(r["text"]))
    for r in mixed.collect():
        assert (r.doc_id, r.text, r.n_chars) in known
        words[r.source] += size(r.text)
    for s, target in water(sizes).items():
        assert abs(words[s] - target) <= longest[s] / 2 + 1
    assert mixing.assign_positions(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def test_native_plans(docs):
    for df in (mixing.assign_positions(docs), mixing.mixed_documents(docs), rules.judge(docs), pii.digest(docs), pii.mask(docs)):
        plan = plan_of(df)
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_quality_counts(docs, no_docs, texts):
    got = collections.Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.judge(docs).collect()
    )
    want = collections.Counter()
    for doc_id, text in texts:
        words = WORD.findall(text or "")
        windows = collections.Counter(zip(words, words[1:], words[2:]))
        repeat = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
        want[doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat), failed] += 1
    assert got == want
    assert rules.judge(no_docs).count() == 0


def test_quality_repeats(spark):
    cases = {"a a a a": 4, "a b c a b c": 6, "a b c d a b c": 6, "a b": 0, "": 0, "a b c": 0, "x y z\nx y z": 6}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    assert [r.n_repeat_words for r in rules.judge(docs).orderBy("doc_id").collect()] == list(cases.values())


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0


def base_spans(text):
    found = []
    for order, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                found.append((m.start(), order, kind, m.end()))
    return sorted(found)


PRIVATE = [
    "a@b.c%x@d.e 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4 é@é.é x@y a.b@c-d.e.f. ..@-.-",
    "call +1 (234) 555-1234, or +49 30 1234567890 (office) +1 (234) 555-1234 10.0.0.1",
    "card 4111 1111 1111 1111, 4111111111111112 5500-0000-0000-0004 3782 822463 10005",
    "iban DE89 3704 0044 0532 0130 00, GB82WEST12345698765432, DE88370400440532013000 ssn 123-45-6789 and 123-45-6789",
    "9" * 20_000, "1." * 9_000, "+1" * 9_000, "a@b.c " * 400, "+1" + "(" * 20_000, "日本 ü@x.de user@x.de 語 1.1.1.1",
]


def test_personal_data_base_spans(spark, docs, no_docs, texts):
    private = [(i + 1000, t) for i, t in enumerate(PRIVATE)]
    extra = spark.createDataFrame(private, "doc_id long, text string")
    got = {(r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.digest(docs.select("doc_id", "text").unionByName(extra)).collect()}
    want = set()
    for doc_id, text in texts + private:
        spans = base_spans(text)
        count = collections.Counter(s[2] for s in spans)
        code = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()
        want.add((doc_id, code, *(count[k] for k, _ in BASE)))
    assert got == want
    assert pii.digest(no_docs).count() == 0


def test_personal_data_more_kinds_and_mask(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*PRIVATE[:4], None, ""])], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.digest(docs).collect()}
    assert "tel:" in spans[1] and spans[3].count("iban:") == 2 and spans[3].count("ssn:") >= 1
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[4] is None and masked[5] == "" and "<IBAN>" in masked[3] and "3704" not in masked[3].split("DE8837")[0]
    assert all(not base_spans(t) for t in masked.values())
