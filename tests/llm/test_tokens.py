import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe, lexicon, token_binary, token_cache
from tessera.llm.chunks import ChunkEncoder
from tessera.llm.common import fresh_path

WORDS, BYTES = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
word_library, byte_library = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
chunks, coder = ChunkEncoder(WORDS, memo_chunks=50, memo_words=50), bpe.ByteBpe(BYTES)

odd = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\x1c\x85\xa0'abST19.,<|ΣσİﬁÀéß")), max_size=60)


def column(*texts):
    return pa.array(texts, pa.string())


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(odd)
def test_chunks_give_the_librarys_ids(text):
    assert chunks.encode(column(text))[0].tolist() == ids(word_library, text)


@settings(max_examples=300, deadline=None)
@given(odd)
def test_byte_bpe_gives_the_librarys_ids_and_text(text):
    got, ends = coder.encode(column(None, text, "", text))
    assert got.tolist() == 2 * ids(byte_library, text) and ends.tolist() == [0, 0, len(got) // 2, len(got) // 2, len(got)]
    assert coder.decode(got, ends) == ["", byte_library.decode(ids(byte_library, text), skip_special_tokens=False), "", text]
    assert coder.decimal(got, ends)[1] == ",".join(map(str, ids(byte_library, text)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=30))
def test_decoding_of_any_ids(values):
    assert coder.decode(np.array(values, np.int64), np.array([0, len(values)])) == [byte_library.decode(values, skip_special_tokens=False)]


def test_all_characters():
    for a in range(0, 0x110000, 997):
        part = "".join(f"x{chr(c)}y {chr(c)}" for c in range(a, min(a + 40, 0x110000)) if not 0xD800 <= c < 0xE000)
        assert coder.encode(column(part))[0].tolist() == ids(byte_library, part)
        assert chunks.encode(column(part))[0].tolist() == ids(word_library, part)


def test_merging_side_by_side_is_merging_one_by_one():
    words = [b"", b"a", b" the", b"antidisestablishmentarianism", b"x" * 40, "naïve".encode(), b"!" * 31, b"zq" * 16]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.merge_many(words)] == [coder.merge(w) for w in words]


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.binary(max_size=6), st.lists(st.integers(0, 9), max_size=3), max_size=40), st.lists(st.binary(max_size=6), max_size=10))
def test_the_lexicon_holds_its_words_alone(tmp_path_factory, entries, others):
    path = tmp_path_factory.mktemp("lexicon") / "l.bin"
    path.write_bytes(lexicon.compile_lexicon(entries))
    held = lexicon.Lexicon(str(path))
    asked = [*entries, *others]
    got = held.ids_of(asked)
    assert [None if g is None else np.frombuffer(g, "<u4").tolist() for g in got] == [entries.get(w) for w in asked]


def test_the_automaton_shares_suffixes():
    few = lexicon.compile_lexicon({p + b"ationally": [1] for p in (b"a", b"b", b"c", b"d")})
    one = lexicon.compile_lexicon({b"ationally": [1]})
    assert len(few) < len(one) + 200


def test_counts_and_cache(spark, docs, nothing):
    cache = token_cache.count_cache(spark)
    got = token_cache.count_tokens(docs, WORDS, cache).collect()
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_bytes, r.n_tokens) == (len(rows[r.doc_id].encode()), len(ids(word_library, rows[r.doc_id])))
        assert r.over_limit == (r.n_tokens > 2048) and not r.cached
    size = cache.read().count()
    assert size == cache.read().distinct().count()
    again = token_cache.count_tokens(docs, WORDS, cache).collect()
    assert all(r.cached for r in again) and cache.read().count() == size
    assert token_cache.count_tokens(nothing, WORDS).count() == 0


def test_a_tokenizer_that_keeps_white_space(spark, docs):
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in token_cache.count_tokens(docs, BYTES).collect():
        assert r.n_tokens == len(ids(byte_library, rows[r.doc_id]))


def test_two_batches_share_counts(spark, tmp_path):
    rows = [(k, f"some words {k % 9}" + "  x" * (k % 2)) for k in range(50)]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in token_cache.op4_digest_cache(spark, str(tmp_path)).collect()}
    assert all(got[k].n_tokens == len(ids(word_library, t)) for k, t in rows) and len(got) == 50
    assert any(r.cached for r in got.values()) and not got[0].cached


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=9), max_size=6))
def test_variable_length_coding_round_trip(rows):
    counts = np.array([len(r) for r in rows], np.int64)
    ranks = np.array([x for r in rows for x in r], np.uint32)
    control, data, control_at, data_at = token_binary.pack(ranks, counts)
    assert control_at[-1] == len(control) and data_at[-1] == len(data)
    raw = token_binary.block(list(range(len(rows))), counts.tolist(), control.tobytes(), data.tobytes())
    found, sizes, back = token_binary.read_block(raw)
    assert found.tolist() == list(range(len(rows))) and sizes.tolist() == counts.tolist() and back.tolist() == ranks.tolist()


def test_file_of_ids(spark, docs, nothing):
    named = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    path = fresh_path(spark, "ids")
    token_binary.write_ids(named, WORDS, path, block_ids=64)
    got = token_binary.read_digests(spark, path).orderBy("doc_id").collect()
    start = 0
    for r, (key, text) in zip(got, sorted((r.doc_id, r.text or "") for r in named.collect()), strict=True):
        want = np.array([*ids(word_library, text), 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    whole = {r.doc_id: r.ids for r in token_binary.read_ids(spark, path).collect()}
    assert whole[3] == [*ids(word_library, "one"), 1]
    empty = fresh_path(spark, "ids")
    token_binary.write_ids(nothing, WORDS, empty)
    assert token_binary.read_digests(spark, empty).count() == 0
    with pytest.raises(Exception, match="without an id"):
        token_binary.write_ids(docs, WORDS, fresh_path(spark, "ids"))


def test_encode_decode_frames(spark, docs, nothing):
    encoded = bpe.encode(docs, BYTES)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.ids == ids(byte_library, texts[r.doc_id]) for r in encoded.collect())
    assert all(r.text == texts[r.doc_id] for r in bpe.decode(encoded, BYTES).collect())
    for r in bpe.round_trip_digests(docs, BYTES).collect():
        want = ids(byte_library, texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.n_tokens == len(want) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.encode(nothing, BYTES).count() == 0


def test_word_counts_cover_all_texts(docs):
    got = {r.word: r.n for r in bpe.word_counts(docs, BYTES).collect()}
    assert got[" ipsum"] == 3000 and got["lorem"] == 1 and got[" lorem"] == 2999
