import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from fleetfootprint.llm import catalog, sentencepieces

CASES = [
    "", " ", "  ", "▁", "▁▁ ", " a", "a ", "<s>", "</s>", "<unk>", "<0x41>", "\x00", "é𝄞", "a" * 5000, " " * 777, "\n" * 333, "ab" * 3000, "  a b  ", "​﻿",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepieces.MODEL))


@pytest.fixture(scope="module")
def model():
    return sentencepieces.load()


def same(model, library, text):
    ids = library.encode(text, add_bos=True, add_eos=True)
    packed = model.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == ids, text
    assert model.decode(packed) == library.decode(ids), text


@pytest.mark.parametrize("text", CASES)
def test_cases(model, library, text):
    same(model, library, text)


def test_random_texts(model, library):
    rng = random.Random(3)
    letters = ["ab ", " aeiou\n", "the in ing  ", "é𝄞▁ xy", "0123456789. ", "aAbB<>s/ "]
    pieces = [p for p in model.pieces if len(p) > 1]
    for _ in range(4000):
        kind = rng.choice(letters)
        same(model, library, "".join(rng.choice(kind) for _ in range(rng.randint(0, 40))))
        same(model, library, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))))


def test_random_ids(model, library):
    rng = random.Random(4)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 259, 28705, 1, 2, 0]) for _ in range(rng.randint(0, 12))]
        assert model.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids
    with pytest.raises(ValueError):
        model.decode(np.array([32000], "<u4").tobytes())


def test_pieces_are_found_by_going_back(model):
    """Taking the longest piece everywhere is wrong for some words, which the search has to repair."""
    greedy_fails = 0
    for piece in list(model.ids)[300:6000]:
        word = piece + "s"
        longest = max((word[:n] for n in range(1, len(word) + 1) if word[:n] in model.ids), key=len)
        greedy_fails += model.split(word)[0] != longest
        assert model.split(word) == model.merged(word)
    assert greedy_fails


def test_memories_may_be_emptied(model, monkeypatch, library):
    monkeypatch.setattr(sentencepieces, "WORDS_KEPT", 2)
    monkeypatch.setattr(sentencepieces, "PAIRS_KEPT", 2)
    for text in CASES + ["one two three four five six seven"]:
        same(model, library, text)


def test_whole_text_as_one_word(model, monkeypatch, library):
    monkeypatch.setattr(model, "splits", False)
    for text in CASES + ["one two  three", "a b c d e f g " * 50]:
        same(model, library, text)


def test_defined_cases(spark, docs, no_docs, texts, library):
    extra = docs.withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x"))
    got = sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in sentencepieces.round_trip(extra).collect())
    coded = [(str(i), library.encode(t or "", add_bos=True, add_eos=True)) for i, t in texts]
    assert got == sorted((i, ids, library.decode(ids)) for i, ids in coded)
    assert sentencepieces.round_trip(no_docs).count() == 0
    plain = sentencepieces.encode(docs, begin=False, end=False)
    assert sorted((str(r[0]), bytes(r[1])) for r in plain.collect()) == sorted((i, np.array(ids[1:-1], "<u4").tobytes()) for i, ids in coded)
    back = sentencepieces.decode(plain.union(spark.createDataFrame([(1, None)], plain.schema)))
    assert back.count() == len(texts) + 1 and back.filter("text is null").count() == 0


def test_query(spark, docs, texts, tmp_path, library):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(str(tuple(r)) for r in catalog.op13_sentencepiece(spark, str(tmp_path)).collect())
    expected = []
    for doc_id, text in texts:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        digests = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
        expected.append(str((doc_id, len(ids), *digests)))
    assert got == sorted(expected)


def random_texts(model, n):
    rng = random.Random(5)
    letters = ["ab ", " aeiou\n", "the in ing  ", "é𝄞▁ xy", "0123456789. ", "aAbB<>s/ ", "\x00﻿　 漢 字"]
    pieces = [p for p in model.pieces if len(p) > 1]
    for _ in range(n):
        kind = rng.choice(letters)
        yield "".join(rng.choice(kind) for _ in range(rng.randint(0, 150)))
        yield "".join(rng.choice(pieces) for _ in range(rng.randint(1, 30)))


@pytest.mark.parametrize("begin, end", [(True, True), (True, False), (False, True), (False, False)])
def test_all_at_once(model, library, begin, end):
    texts = [*CASES, *random_texts(model, 2000), *CASES, ""]
    expected = [library.encode(text, add_bos=begin, add_eos=end) for text in texts]
    column = pa.array(["cut off", *texts, "cut off"]).slice(1, len(texts))
    packed = model.encode_all(column, begin, end)
    packed.validate(full=True)
    assert [np.frombuffer(one, "<u4").tolist() for one in packed.to_pylist()] == expected
    decoded = model.decode_all(packed)
    decoded.validate(full=True)
    assert decoded.to_pylist() == [library.decode(ids) for ids in expected]
    for few in ([], [""], ["", ""], [" "], ["w" * 99], ["a"]):
        packed = model.encode_all(pa.array(few, pa.string()), begin, end)
        assert packed.to_pylist() == [model.encode(text, begin, end) for text in few]
        assert model.decode_all(packed).to_pylist() == [model.decode(one) for one in packed.to_pylist()]


def test_random_ids_at_once(model, library):
    rng = random.Random(6)
    lists = [[rng.choice([rng.randrange(32000), rng.randrange(3, 259), 259, 28705, 1, 2, 0]) for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    column = pa.array([b"....", *(np.array(ids, "<u4").tobytes() for ids in lists)], pa.binary()).slice(1)
    assert model.decode_all(column).to_pylist() == [library.decode(ids) for ids in lists]
    for wrong in (np.array([1, 32000], "<u4").tobytes(), b"abc"):
        with pytest.raises(ValueError):
            model.decode_all(pa.array([b"", wrong], pa.binary()))


def test_all_at_once_with_emptied_memories_and_whole_texts(model, monkeypatch, library):
    monkeypatch.setattr(sentencepieces, "PAIRS_KEPT", 2)
    monkeypatch.setattr(sentencepieces, "SIDE_BY_SIDE", 3)
    texts = CASES + ["one two three four five six seven", "a b c d e f g " * 50]
    expected = [library.encode(text, add_bos=True, add_eos=True) for text in texts]
    for splits in (True, True, False):
        monkeypatch.setattr(model, "splits", splits)
        assert [np.frombuffer(one, "<u4").tolist() for one in model.encode_all(pa.array(texts)).to_pylist()] == expected


def test_varied_words_are_not_searched_one_by_one(model, monkeypatch, library):
    """The time went into searching every word that the memory didn't have by itself; now only long words take that way."""
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("abdeghinorst") for _ in range(rng.randint(4, 12))) for _ in range(300)) for _ in range(20)]
    texts += ["long " + "word" * 30, "", "two  spaces  "]

    class Local:
        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
            return [row for out in run(iter([batch, batch.slice(0, 0)])) for row in out.to_pylist()]

    searched, split = [], model.split
    monkeypatch.setattr(model, "split", lambda word: searched.append(word) or split(word))
    monkeypatch.setattr(model, "words", {})
    monkeypatch.setattr(sentencepieces, "_texts", lambda *_: Local())
    monkeypatch.setattr(sentencepieces, "IN_BYTES", 20_000, raising=False)
    got = sentencepieces.round_trip(None)
    expected = [library.encode(text, add_bos=True, add_eos=True) for text in texts]
    assert [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got] == [*enumerate(expected)]
    assert [r["decoded"] for r in got] == [library.decode(ids) for ids in expected]
    assert len(searched) < 10
