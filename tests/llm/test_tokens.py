import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkgrove.llm import packing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@given(st.lists(st.text(st.sampled_from(list("ab'sEé\u0301 \n\t\u00a0\u2028\x1c.,1<|>İΣ")) | st.characters(codec="utf-8"), max_size=40), max_size=6))
@settings(max_examples=200, deadline=None)
def test_words_give_the_texts_ids(tokenizer, texts):
    encoder = tokens.TextEncoder.get(PATH)
    texts = [*texts, "a<|endoftext|>b c<|endoftext|>"]
    got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts, 2)]
    assert got == [[*ids_of(tokenizer, x), 2] for x in texts]


@given(st.lists(st.integers(0, 5000), max_size=400))
@settings(max_examples=100, deadline=None)
def test_elias_fano(steps):
    values = np.cumsum(np.array(steps, np.int64))
    ef = tokens.EliasFano.from_bytes(tokens.EliasFano.of(values).to_bytes())
    assert ef.values().tolist() == values.tolist() == [ef.select(i) for i in range(len(values))]
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_elias_fano_space():
    values = np.cumsum(np.random.default_rng(0).integers(1, 4000, 50_000))
    assert len(tokens.EliasFano.of(values).to_bytes()) * 8 < len(values) * (np.log2(values[-1] / len(values)) + 3)


def test_file_reads_single_documents():
    docs = [[5, 6, 2], [2], [], [9] * 500]
    file = tokens.TokenFile(tokens.file_bytes([np.array(x, "<u2").tobytes() for x in docs], 2, [3, None, -4, 1 << 40]))
    assert [file.document(i).tolist() for i in range(len(file))] == docs
    assert file.doc_ids == [3, None, -4, 1 << 40]


@pytest.mark.parametrize("name", ["documents", "odd_documents"])
@pytest.mark.parametrize("shard_ids", [500, tokens.SHARD_IDS])
def test_token_files(request, tokenizer, name, shard_ids):
    docs = request.getfixturevalue(name)
    want, start = [], 0
    for r in sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, zlib.crc32((r.text or "").encode()), r.text or "")):
        ids = [*ids_of(tokenizer, r.text), 2]
        want.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    got = tokens.read_token_files(tokens.write_token_files(docs, PATH, 2, shard_ids=shard_ids))
    assert sorted(map(tuple, got.collect()), key=lambda x: x[1]) == want


def test_no_documents(no_documents):
    assert tokens.read_token_files(tokens.write_token_files(no_documents, PATH, 2)).count() == 0
    assert packing.pack_documents(no_documents, PATH, 1).count() == 0


@given(st.lists(st.integers(1, 100), max_size=60), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_differencing(sizes, k):
    windows = packing.differencing(sizes, k)
    assert len(windows) == k and sorted(i for w in windows for i in w) == list(range(len(sizes)))
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert max(sums) - min(sums) <= max(sizes, default=0)


def test_differencing_known():
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]


@given(st.lists(st.integers(1, 100), max_size=60))
@settings(max_examples=100, deadline=None)
def test_whole_items_keep_to_the_capacity(sizes):
    windows = packing.pack_items(sizes, 100)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 100 for w in windows)


@pytest.mark.parametrize("name", ["documents", "odd_documents"])
@pytest.mark.parametrize(("capacity", "block"), [(2048, packing.BLOCK_WINDOWS), (128, 4)])
def test_packing(request, tokenizer, name, capacity, block):
    docs = request.getfixturevalue(name).repartition(2)
    rows = packing.pack_documents(docs, PATH, 1, capacity, block).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append([*ids_of(tokenizer, r.text), 1])
    for key, all_ids in texts.items():
        if len(all_ids) == 1:
            at = 0
            for p in sorted(pieces[key], key=lambda p: p.start):
                assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(all_ids[0]), crc(all_ids[0][at : at + p.length]))
                at += p.length
            assert at == len(all_ids[0])
        assert sum(p.length for p in pieces[key]) == sum(map(len, all_ids))
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity and {p.padded_length for p in ps} == {at if at & (at - 1) == 0 else capacity}
    for p in rows:
        assert p.length == p.doc_tokens or p.doc_tokens > capacity and (p.length == capacity or p.start + p.length == p.doc_tokens)


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    rows = packing.pack_documents(docs, PATH, 1).collect()
    windows = {r.sequence_id: r.padded_length for r in rows}
    assert sum(windows.values()) < 1.03 * sum(r.length for r in rows)
    assert all(r.length == r.doc_tokens for r in rows if r.doc_tokens <= 2048)


@given(st.lists(st.text(st.sampled_from(list("aZsßÿªµÀé.,;!?'<|endoftx>SD ")), max_size=24), max_size=8))
@settings(max_examples=400, deadline=None)
def test_latin_words_give_the_texts_ids(tokenizer, texts):
    encoder = tokens.TextEncoder.get(PATH)
    texts = [*texts, "<|ENDOFTEXT|>. <|endoftext|>, É.É, it's. A.,b"]
    got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts, 2)]
    assert got == [[*ids_of(tokenizer, x), 2] for x in texts]


def test_capitals_and_signs_after_words_are_no_words_of_their_own(tokenizer):
    tokens.TextEncoder.forget()
    encoder = tokens.TextEncoder.get(PATH)
    texts = ["The the THE. the, The; the!\nthe: THE? tHe Écoute. the", "the&&& The&&&"]
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts, 2)] == [[*ids_of(tokenizer, x), 2] for x in texts]
    assert len(encoder.words) <= 12


#: Runs of signs, letters that lower case or normalizing turn into others, special tokens in capitals.
ODD_WORDS = ["a.. b", "a,. B", "“A”. b", "É, é. Œ; ×. b", "İ. b İ, İ. i", "H̱. ẖ T̈, Á. b", "<|ENDOFTEXT|>. A <|endoftext|>. A", "5. ²., ٣. b", "it's. IT'S, it'. '. b", "K. İİ; ŉ. ǅ, b", "a \x1c. b\t. c", "Σ. ΑΣ. b", "..", ". A", ""]


@pytest.mark.parametrize("text", ODD_WORDS)
def test_odd_words_give_the_texts_ids(tokenizer, text):
    encoder = tokens.TextEncoder.get(PATH)
    texts = [text, f"{text} ", f"x {text}. Y"]
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts, 2)] == [[*ids_of(tokenizer, x), 2] for x in texts]


def test_kept_words_change_nothing(documents):
    texts = [r.text or "" for r in documents.limit(200).collect()]
    encoder = tokens.TextEncoder.get(PATH)
    assert list(encoder.encode(texts, 2, 50)) == list(encoder.encode(texts, 2))
