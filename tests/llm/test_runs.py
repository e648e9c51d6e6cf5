import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from fleetfootprint.llm import catalog, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """Every maximal stretch per period by comparing words, without those whose smallest period is shorter."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                if not any(all(words[t] == words[t + p] for t in range(i, j + q - p)) for p in range(1, q)):
                    found.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_random_words_against_brute_force():
    rng = random.Random(1)
    some = 0
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 6)):
            text, letters = [], rng.randint(1, 4)
            for _ in range(rng.randint(0, 5)):
                part = [rng.randrange(letters) for _ in range(rng.randint(1, 9))]
                text += (part * rng.randint(1, 9))[: rng.randint(1, 60)]
            texts.append(np.array(text, np.int64))
        for text, found in zip(texts, runs.find_runs(texts)):
            expected = brute(text.tolist())
            some += len(expected)
            assert found == expected
    assert some > 500


def test_fibonacci_words_and_one_long_run():
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    long = np.tile(np.arange(37), 2000)
    found = runs.find_runs([np.array(b), long, np.zeros(5, np.int64), np.zeros(6, np.int64)])
    assert found[0] == brute(b)
    assert found[1:] == [[(0, len(long), 37)], [], [(0, 6, 1)]]


def test_wavelet_tree():
    rng = np.random.default_rng(2)
    for n in (1, 2, 63, 64, 65, 1000):
        values = rng.permutation(n)
        tree = runs.WaveletTree(values)
        low = rng.integers(0, n, 50)
        high = low + 1 + (rng.random(50) * (n - low)).astype(int)
        limit, rank = rng.integers(0, n, 50), (rng.random(50) * (high - low)).astype(int)
        assert tree.below(low, high, limit).tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(low, high, limit)]
        assert tree.smallest(low, high, rank).tolist() == [int(np.sort(values[a:b])[r]) for a, b, r in zip(low, high, rank)]


def test_defined_cases(spark, docs, no_docs, texts):
    extra = docs.withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("x")).withColumn("words", F.lit(2))
    got = sorted((str(r["doc_id"]), [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.periodic_runs(extra).collect())
    expected = []
    for doc_id, text in texts:
        words = WORD.findall(text or "")
        found = brute(words)
        expected.append((str(doc_id), found, collapsed(words, found)))
    assert got == sorted(expected)
    assert runs.periodic_runs(no_docs).count() == 0


def test_groups_do_not_matter(spark, docs, monkeypatch):
    whole = sorted(map(str, runs.periodic_runs(docs).collect()))
    batch = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).toArrow().to_batches()
    monkeypatch.setattr(runs, "GROUP_WORDS", 1)
    single = [row for part in runs._tasks(iter(batch)) for row in part.to_pylist()]
    assert len(single) == len(whole)
    by_id = {str(r["doc_id"]) + r["collapsed"]: [tuple(x.values()) for x in r["runs"]] for r in single}
    for row in runs.periodic_runs(docs).collect():
        assert by_id[str(row["doc_id"]) + row["collapsed"]] == [tuple(x) for x in row["runs"]]


def test_query_against_brute_force(spark, docs, tmp_path):
    rng = random.Random(5)
    more = [(i, " \n".join(rng.choice("abc") for _ in range(rng.randint(0, 150)))) for i in range(200, 500)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in catalog.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    expected = []
    for doc_id, text in rows.collect():
        words = planted(WORD.findall(text or ""), doc_id) if doc_id is not None else WORD.findall(text or "")
        found = brute(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        listing = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (listing, collapsed(words, found))]
        expected.append((doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, *digest))
    assert got == sorted(expected, key=str)
    assert sum(1 for row in got if row[1]) > 20
