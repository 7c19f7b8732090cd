"""Tokens, places and the number of sequences of the packing."""
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from issuelens.llm import packing
from issuelens.llm.common import tokenizer_path
from issuelens.llm.textbytes import text_chunks

PATH = tokenizer_path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def whole(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([*"aAbJTre'' .,!<|>&$#éİſǨ 0२\n\t=≠̸-ñ中😀", "<|endoftext|>", "'re", "'LL"]), max_size=14).map("".join))
def test_runs_give_the_tokens_of_the_whole_text(text):
    words = packing.LOADED.setdefault(PATH, packing.WordTokens(PATH))
    got = [i for c in text_chunks(pa.array([text])) for i in words.encode(*packing.token_runs(c))[0].tolist()]
    assert got == whole(text)[:-1]


def test_letters_go_to_the_model_alone(monkeypatch):
    """Every Latin letter, by itself and among others, has the tokenizer's ids without the costly whole path."""
    letters = [c for c in map(chr, range(0x180)) if c.isalpha() and c not in "İªµº"]
    texts = [*letters, "".join(letters), *(f"{a}re{a}x" for a in letters), "THE", "größe", "ÉTÉ"]
    other = ["İ", "µ", "e\u0301", "'re", "a1", "日本", "don't"]
    want = [whole(t)[:-1] for t in texts + other]
    words = packing.WordTokens(PATH)
    seen = []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return TOKENIZER.encode_batch_fast(texts, **options)
    monkeypatch.setattr(words, "tokenizer", Counting())
    words.add(list(range(len(want))), texts + other)
    ends = np.cumsum(words.count[:len(want)])
    assert [words.ids[b - n:b].tolist() for b, n in zip(ends, words.count)] == want
    assert seen == other


def check(rows, docs, capacity):
    """Round trip: the pieces are the documents' ids, and the sequences have no gap and no overflow."""
    want = []
    for r in docs:
        ids = np.array(whole(r.text), "<u4")
        want += [(r.doc_id, p, a, len(ids[a:a + capacity]), zlib.crc32(ids[a:a + capacity].tobytes()))
                 for p, a in enumerate(range(0, len(ids), capacity))]
    plain = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted((tuple(r)[:5] for r in rows), key=plain) == sorted(want, key=plain)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places), sum(w[3] for w in want)


@pytest.mark.parametrize("rest,capacity", [(20_000, 4096), (5, 256)])
def test_pack_documents(spark, more, monkeypatch, rest, capacity):
    monkeypatch.setattr(packing, "REST", rest)
    rows = packing.pack(packing.tokenize(more, PATH, capacity), capacity).collect()
    n, tokens = check(rows, more.select("doc_id", "text").collect(), capacity)
    assert n <= 1.01 * -(-tokens // capacity) + 1


def test_assemble(spark, docs):
    packed = packing.pack(packing.tokenize(docs, PATH, with_ids=True))
    ids = {r.doc_id: whole(r.text) for r in docs.collect()}
    for s in packing.assemble(packed).collect():
        got = np.frombuffer(bytes(s.ids), "<u4").tolist()
        assert len(got) == s.length <= packing.CAPACITY
        if len(s.doc_ids) > 1:
            assert got[:len(ids[s.doc_ids[0]])][-1] == ids[s.doc_ids[0]][-1]


def test_pack_odd_rows(odd, none):
    check(packing.pack(packing.tokenize(odd, PATH)).collect(), odd.select("doc_id", "text").collect(), packing.CAPACITY)
    assert packing.pack(packing.tokenize(none, PATH)).count() == 0


@pytest.mark.parametrize("mean,pieces", [(6.7, 200_000), (6.2, 15_000), (5.5, 40_000)])
def test_the_program_packs_nearly_all_pieces(mean, pieces):
    """All but a twentieth, and never more than REST, go by configurations; sequences are near the bound, the plan is small."""
    rng = np.random.default_rng(1)
    lengths, counts = np.unique(np.minimum(rng.lognormal(mean, 0.9, pieces).astype(int) + 2, 4096), return_counts=True)
    plan = packing.Plan(lengths, counts, 4096)
    short = counts[lengths < 4096].sum()
    assert short - plan.placed <= min(packing.REST, short // 20)
    assert plan.bins <= 1.002 * -(-(lengths * counts).sum() // 4096)
    assert len(plan.runs) <= 100_000


@pytest.mark.parametrize("lengths,counts,bins", [([2049], [1000], 1000), ([1], [5000], 2), ([4095, 1], [300, 300], 300), ([1366], [10], 5),
                                                 ([3000, 1000, 96], [500, 500, 500], 500), ([4096], [7], 7)])
def test_plans_of_few_lengths(lengths, counts, bins):
    order = np.argsort(lengths)
    plan = packing.Plan(np.array(lengths)[order], np.array(counts)[order], 4096)
    assert plan.bins == bins
    taken = {}
    for c, first, bin_, each, slot in plan.runs:
        taken.setdefault(c, []).append(first)
    assert all(len(v) == len(set(v)) for v in taken.values())
