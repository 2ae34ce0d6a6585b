"""Packing against a plain piece-by-piece greedy, and the contents of the sequences."""

import collections
import json
import random
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from tokenizers import Tokenizer

from corrobora.llm import packing
from corrobora.llm.queries import tokenizer_path

from .test_corpus import SCHEMA, awkward, prose

PATH = tokenizer_path("word_bpe_49k.json")


def one_by_one(lengths, capacity):
    """The gaps that are left when every piece is placed on its own: pairs of large ones, then best fit, longest first."""
    large, small = sorted(x for x in lengths if 3 * x > capacity), sorted((x for x in lengths if 3 * x <= capacity), reverse=True)
    gaps = []
    while large:
        a = large.pop()
        fits = [b for b in large if a + b <= capacity]
        if fits:
            large.remove(fits[-1])
        gaps.append(capacity - a - (fits[-1] if fits else 0))
    for x in small:
        best = min((g for g in gaps if g >= x), default=None)
        if best is None:
            gaps.append(capacity - x)
        else:
            gaps.remove(best)
            gaps.append(best - x)
    return collections.Counter(gaps)


def check(runs, counts, capacity):
    fill = collections.defaultdict(list)
    for length in counts:
        rank = 0
        for _, first, n, sequence, each, offset in sorted(r for r in runs if r[0] == length):
            assert first == rank
            rank += n
            for i in range(n):
                fill[sequence + i // each].append((offset + i % each * length, length))
        assert rank == counts[length]
    for held in fill.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(fill) == list(range(len(fill)))
    return collections.Counter(capacity - sum(x for _, x in held) for held in fill.values())


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_the_greedy_piece_by_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 12, 30, 100, 101])
    top = rng.choice([capacity, capacity // 2, max(1, capacity // 3), capacity // 4])
    lengths = [rng.randint(1, max(1, top)) for _ in range(rng.randint(0, 300))]
    lengths += [rng.randint(1, capacity)] * rng.choice([0, 1, 200])
    counts = collections.Counter(lengths)
    assert check(packing.plan(counts, capacity), counts, capacity) == one_by_one(lengths, capacity)


def test_plan_stays_small():
    rng = random.Random(5)
    counts = {n: rng.randint(1, 10**9) for n in range(1, 4097)}
    runs = packing.plan(counts, 4096)
    assert len(runs) < 60_000
    used = max(r[3] + -(-r[2] // r[4]) for r in runs)
    # large lengths cannot all be paired: the bound counts them as well as the tokens
    assert used >= sum(k * n for k, n in counts.items()) / 4096


def encoded(text):
    tokenizer = Tokenizer.from_file(PATH)
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("capacity", [16, 4096])
def test_documents(spark, capacity):
    rng = random.Random(9)
    rows = awkward() + [(99, prose(rng, 3000) + " É x y İ é <|endoftext|>z " + "\x00\x85", "", "", 0, 0, 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    packed = packing.pack_documents(docs, PATH, capacity, with_ids=True)
    got = packed.collect()
    want = collections.Counter()
    for r in rows:
        ids = encoded(r[1])
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[r[0], k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    placed = collections.defaultdict(list)
    for r in got:
        placed[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    for held in placed.values():
        at = 0
        for offset, length, _ in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    assert len(placed) >= -(-total // capacity)
    gaps = collections.Counter(capacity - sum(x[1] for x in held) for held in placed.values())
    assert gaps == one_by_one([r.length for r in got], capacity)
    whole = {r.sequence_id: (bytes(r.ids), list(r.lengths)) for r in packing.sequences(packed).collect()}
    assert whole == {k: (b"".join(x[2] for x in sorted(v)), [x[1] for x in sorted(v)]) for k, v in placed.items()}


def test_no_documents(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_long_text_is_read_in_slices():
    encode = packing.IdBytes(PATH)
    text = " ".join(f"w{i % 977} xé" for i in range(200_000))
    chunks = list(encode.encode(text.encode()))
    assert len(chunks) > 1
    assert np.frombuffer(b"".join(chunks), "<u4").tolist() == encoded(text)[:-1]


def test_forgotten_words_are_learned_again(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 1000)
    encode = packing.IdBytes(PATH)
    for k in range(30):
        text = " ".join(f"word{k + i} common" for i in range(40))
        assert np.frombuffer(b"".join(encode.encode(text.encode())), "<u4").tolist() == encoded(text)[:-1]


def test_short_texts_share_a_call_for_their_new_words(monkeypatch):
    monkeypatch.setattr(packing, "TOGETHER", 2000)
    texts = [" ".join(f"word{i}x{j} é{j}." for j in range(20)).encode() for i in range(40)] + [b"", b" \n ", b"again " * 900, b"last one"]
    encode, calls = packing.IdBytes(PATH), []
    tokenizer = encode.tokenizer

    class Counted:
        def encode(self, text, **options):
            calls.append(text)
            return tokenizer.encode(text, **options)

    encode.tokenizer = Counted()
    got = [b"".join(ids) for ids in encode.encode_all(texts)]
    assert got == [np.array(tokenizer.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert len(calls) < len(texts) / 3


def test_plain_words_have_the_tokenizers_ids():
    encode = packing.IdBytes(PATH)
    assert encode.model is not None
    signs = [chr(c) for c in [*range(1, 0x250), 0x301, 0x3A3, 0x2019, 0x2028, 0x20AC, 0xFB01, 0xFFFD, 0x1F600]]
    texts = [f"{c} a{c}B 'S{c}1{c}! {c}{c}'ll É{c}" for c in signs] + ["DON'T we'Re x<|endoftext|>y 42nd ''s", " \x0b\x1c a\xa0b ", "\u0130\u0178"]
    got = [b"".join(ids) for ids in encode.encode_all(t.encode() for t in texts)]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_part_is_given_to_the_model_once():
    encode, asked = packing.IdBytes(PATH), []
    model, whole = encode.model, encode.tokenizer

    class Counted:
        def tokenize(self, text):
            asked.append(text)
            return model.tokenize(text)

    encode.model, encode.tokenizer = Counted(), None
    text = "Word word, (word) word's wörd. WÖRD! 77"
    assert np.frombuffer(b"".join(encode.encode(text.encode())), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert len(asked) == len(set(asked)) == 9


def test_tasks_of_a_process_share_an_encoder():
    # tasks get the library by value
    other = cloudpickle.loads(cloudpickle.dumps(packing.encoder))
    assert other is not packing.encoder
    assert other(PATH) is packing.encoder(PATH)


@pytest.mark.parametrize("change", ["cutting", "added"])
def test_other_tokenizers_are_asked_for_whole_words(tmp_path, change):
    made = json.loads(Tokenizer.from_file(PATH).to_str())
    if change == "cutting":
        made["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": "[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]+"}
    else:
        made["added_tokens"][0] |= {"content": "<|start|>", "special": False, "normalized": True}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(made))
    encode = packing.IdBytes(str(path))
    text = "a1b22 don't <|START|> über 2nd"
    ids = Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids
    assert encode.model is None
    assert np.frombuffer(b"".join(encode.encode(text.encode())), "<u4").tolist() == ids != encoded(text)[:-1]
