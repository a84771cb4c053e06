"""Byte-level BPE encoding and decoding over a lexicon of frequent words.

The corpus's word counts (over all texts) choose the frequent words; their exact ids are
compiled into a minimal acyclic transducer, which every worker memory-maps. A text is cut
at its white-space runs, each piece into words; a word's ids come from the lexicon, or
for unseen words from exact merging by rank. Which words the lexicon holds changes the
speed alone. Decoding joins the tokens' bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chunks import small_batches
from tessera.llm.common import most_frequent, ship, stored, whole_text
from tessera.llm.lexicon import Lexicon, compile_lexicon
from tessera.llm.pieces import distinct, gather, lists, split_before_space

#: Words in the lexicon at most, so what goes to the driver and the workers is bounded.
LEXICON_WORDS = 1 << 17
#: Pieces that a worker holds the ids of, or the counts of, at most; and words.
HELD_PIECES = 400_000
HELD_WORDS = 500_000
#: Words of more bytes are merged one by one, with a heap.
LONG = 32
_NO_MERGE = np.iinfo(np.int32).max

_CODERS: dict[tuple, "ByteBpe"] = {}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    visible Latin-1 characters for themselves, the others from U+0100 on in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class ByteBpe:
    """Encodes and decodes as the tokenizers library does with the same file and
    ``add_special_tokens=False`` (special strings inside texts are special tokens)."""

    def __init__(self, path: str, lexicon: Lexicon | None = None):
        import regex

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model, before = config["model"], config["pre_tokenizer"]
        if config["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("not a plain byte-level tokenizer")
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
            raise ValueError("not a plain BPE model")
        self.words_of = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        vocab = model["vocab"]
        self.bytes_of = {i: bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode() for token, i in vocab.items()}
        self.single = [vocab[c] for c in byte_characters()]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merge_of = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        keys = np.array([a << 32 | b for a, b in self.merge_of], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merge_of.values()], np.int64)[order]
        self.rank_ids = np.zeros(len(keys), np.int32)
        self.rank_ids[[r for r, _ in self.merge_of.values()]] = [i for _, i in self.merge_of.values()]
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in config["added_tokens"]):
            raise ValueError("added tokens with options")
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.mark = re.compile("[" + re.escape("".join({s[0] for s in self.special})) + "]").search
        most = max(self.bytes_of) + 1
        self.token_bytes = pa.array([self.bytes_of.get(i, b"") for i in range(most)], pa.large_binary())
        self.token_decimal = pa.array([str(i) for i in range(most)], pa.large_string())
        self.lexicon = lexicon
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Merges the pair of lowest rank, leftmost first, until none is left."""
        ids, merge_of = [self.single[b] for b in word], self.merge_of
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(f[0], k, f[1], ids[k], ids[k + 1]) for k in range(n - 1) if (f := merge_of.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)

        def push(k):
            if k >= 0 and after[k] < n and (f := merge_of.get((ids[k], ids[after[k]]))):
                heapq.heappush(heap, (f[0], k, f[1], ids[k], ids[after[k]]))

        while heap:
            _, k, new, left, right = heapq.heappop(heap)
            if ids[k] != left or after[k] >= n or ids[after[k]] != right:
                continue
            gone = after[k]
            ids[k], ids[gone], after[k] = new, -1, after[gone]
            if after[k] < n:
                before[after[k]] = k
            push(before[k])
            push(k)
        return [i for i in ids if i >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (right >= 0), self.pair_ranks[at], _NO_MERGE).astype(np.int32)

    def _merge_block(self, words: list[bytes]) -> list[bytes]:
        """Merges short words side by side: each step merges every word's best pair."""
        n, width = len(words), max(map(len, words)) + 1
        length = np.fromiter(map(len, words), np.int64, n)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width)[None, :] < length[:, None]] = np.array(self.single, np.int32)[np.frombuffer(b"".join(words), np.uint8)]
        ranks = self._ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        out: list[bytes] = [b""] * n
        row, place = np.arange(n), np.arange(width)
        while True:
            best = ranks.argmin(axis=1)
            low = ranks[np.arange(len(row)), best]
            done = low == _NO_MERGE
            if done.any():
                rest = ids[done]
                sizes = (rest >= 0).sum(axis=1)
                flat = rest[rest >= 0].astype("<u4").tobytes()
                ends = np.cumsum(sizes) * 4
                for k, a, b in zip(row[done].tolist(), (ends - sizes * 4).tolist(), ends.tolist(), strict=True):
                    out[k] = flat[a:b]
                row, ids, ranks, best, low = row[~done], ids[~done], ranks[~done], best[~done], low[~done]
            if not len(row):
                return out
            every = np.arange(len(row))
            # what stands right of the merged pair moves one to the left
            ids = np.concatenate([np.take_along_axis(ids, np.minimum(place[None, :] + (place[None, :] > best[:, None]), width - 1), 1)[:, :-1], np.full((len(row), 1), -1, np.int32)], axis=1)
            ids[every, best] = self.rank_ids[low]
            ranks = np.concatenate([np.take_along_axis(ranks, np.minimum(place[None, :-1] + (place[None, :-1] > best[:, None]), width - 2), 1)[:, :-1], np.full((len(row), 1), _NO_MERGE, np.int32)], axis=1)
            ranks[every, best] = self._ranks(ids[every, best], ids[every, np.minimum(best + 1, width - 1)])
            left = best > 0
            ranks[every[left], best[left] - 1] = self._ranks(ids[every[left], best[left] - 1], ids[every[left], best[left]])

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        order = sorted((len(w), k) for k, w in enumerate(words))
        short = [k for n, k in order if 0 < n <= LONG]
        for a in range(0, len(short), 8192):  # of about equal lengths
            part = short[a : a + 8192]
            for k, got in zip(part, self._merge_block([words[k] for k in part]), strict=True):
                out[k] = got
        for n, k in order:
            if n > LONG:
                out[k] = np.array(self.merge(words[k]), "<u4").tobytes()
        return out

    def learn(self, pieces: list[str]) -> None:
        """Puts the pieces' ids into the memo."""
        known, words_of = self.words, self.words_of
        # most pieces are one word: letters, perhaps after a space
        cut = [(p,) if p.isalpha() or p[0] == " " and p[1:].isalpha() else words_of(p) for p in pieces]
        words = list({w for ws in cut for w in ws if w not in known})
        if len(known) + len(words) > HELD_WORDS:
            # words in use stay
            self.words = known = {w: known[w] for ws in cut for w in ws if w in known}
        raw = [w.encode() for w in words]
        if self.lexicon:
            known.update(zip(words, self.lexicon.ids_of(raw), strict=True))
            unseen = [k for k, w in enumerate(words) if known[w] is None]
        else:
            unseen = list(range(len(words)))
        known.update(zip([words[k] for k in unseen], self.merge_many([raw[k] for k in unseen]), strict=True))
        get = known.__getitem__
        self.memo.update(zip(pieces, [b"".join(map(get, ws)) for ws in cut], strict=True))

    def _values(self, pieces: list[str]) -> list[bytes]:
        """Each piece's ids; special strings inside are special tokens."""
        got = list(map(self.memo.get, pieces))
        new = [p for p, g in zip(pieces, got, strict=True) if g is None]
        if len(self.memo) + len(new) > HELD_PIECES:  # pieces in use stay
            self.memo = {p: g for p, g in zip(pieces, got, strict=True) if g is not None}
        plain = [p for p in new if not self.mark(p)]
        for k in range(0, len(plain), HELD_WORDS // 8):  # so that their words fit
            self.learn(plain[k : k + HELD_WORDS // 8])
        for p in new:
            if p not in self.memo:
                self.memo[p] = self._cut_at_special(p)
        get = self.memo.__getitem__
        return [get(p) if g is None else g for p, g in zip(pieces, got, strict=True)]

    def _cut_at_special(self, piece: str) -> bytes:
        out = []
        for part in self.cut(piece):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                out += self.merge_many([w.encode() for w in self.words_of(part)])
        return b"".join(out)

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow array's texts in a row, and where each text's begin (one more for the end)."""
        pieces, first = split_before_space(column)
        values, places = distinct(pieces)
        return gather(self._values(values), places, first, np.dtype("<u4"))

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts whose ids, all in a row, begin at ``ends``; unknown ids are left out."""
        known = (ids >= 0) & (ids < len(self.token_bytes))
        taken = self.token_bytes.take(pa.array(np.where(known, ids, 0), pa.int64()))
        if not known.all():
            taken = pc.if_else(pa.array(known), taken, pa.scalar(b"", pa.large_binary()))
        return [x.decode("utf-8", "replace") for x in pc.binary_join(lists(taken, ends), pa.scalar(b"", pa.large_binary())).to_pylist()]

    def decimal(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Each text's ids as decimal numbers joined by commas."""
        return pc.binary_join(lists(self.token_decimal.take(pa.array(ids, pa.int64())), ends), pa.scalar(",", pa.large_string())).to_pylist()


def _coder(path: str, name: str | None) -> ByteBpe:
    key = (path, name, os.getpid())
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = ByteBpe(path, Lexicon(SparkFiles.get(name)) if name else None)
    return _CODERS[key]


def _count_words(path: str):
    def count(batches):
        coder, held = _coder(path, None), Counter()

        def out():
            words = Counter()
            for piece, n in held.items():
                if piece.isalpha() or piece[0] == " " and piece[1:].isalpha():
                    words[piece] += n
                    continue
                for part in coder.cut(piece) if coder.mark(piece) else (piece,):
                    for word in coder.words_of(part) if part not in coder.special else ():
                        words[word] += n
            held.clear()
            names, counts = list(words), list(words.values())
            for k in range(0, len(names), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(names[k : k + 50_000], pa.string()), pa.array(counts[k : k + 50_000], pa.int64())], names=["word", "n"])

        for batch in small_batches(batches):
            pieces, places = distinct(split_before_space(batch.column("text"))[0])
            for piece, n in zip(pieces, np.bincount(places, minlength=len(pieces)).tolist(), strict=True):
                held[piece] += n
            if len(held) > HELD_PIECES:
                yield from out()
        yield from out()

    return count


def word_counts(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts; each task's partial counts meet in one sum."""
    ship(docs.sparkSession)
    texts = docs.select(whole_text(text_col).alias("text"))
    return texts.mapInArrow(_count_words(tokenizer_path), "word STRING, n BIGINT").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer_path: str, most: int = LEXICON_WORDS, text_col: str = "text") -> str:
    """Compiles the most frequent words, gives the file to all workers, returns its name."""
    counts = stored(word_counts(docs, tokenizer_path, text_col), "word-counts")
    words = [r["word"] for r in most_frequent(counts, most).select("word").collect()]
    coder = ByteBpe(tokenizer_path)
    raw_words = [w.encode() for w in words]
    raw = compile_lexicon({w: np.frombuffer(ids, "<u4").tolist() for w, ids in zip(raw_words, coder.merge_many(raw_words), strict=True)})
    name = f"lexicon-{hashlib.sha256(raw).hexdigest()[:24]}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), name)
    with open(path, "wb") as f:
        f.write(raw)
    context = docs.sparkSession.sparkContext
    if name not in {os.path.basename(p) for p in context.listFiles}:
        context.addFile(path)
    return name


def _encode(path: str, name: str):
    def encode(batches):
        coder = _coder(path, name)
        for batch in small_batches(batches, most=4 << 20):
            ids, ends = coder.encode(batch.column("text"))
            rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view("<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("row"), rows], names=["row", "ids"])

    return encode


def encode(docs: DataFrame, tokenizer_path: str, lexicon: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ids.

    Null texts count as empty and have no ids. Texts are encoded whole. Ids of rows are
    only carried: they may be null or repeat. An empty table gives no rows.
    """
    lexicon = lexicon or build_lexicon(docs, tokenizer_path, text_col=text_col)
    named = docs.select(F.col(id_col).alias("row"), whole_text(text_col).alias("text"))
    kind = named.schema["row"].dataType.simpleString()
    return named.mapInArrow(_encode(tokenizer_path, lexicon), f"row {kind}, ids ARRAY<INT>").withColumnRenamed("row", id_col)


def _decode(path: str):
    def decode(batches):
        coder = _coder(path, None)
        for batch in batches:
            rows = pc.fill_null(batch.column("ids"), [])
            ends = rows.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            ids = rows.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(coder.decode(ids, ends - ends[0]), pa.string())], names=["row", "text"])

    return decode


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``encoded``: id, text. Null ids give an empty text."""
    ship(encoded.sparkSession)
    named = encoded.select(F.col(id_col).alias("row"), "ids")
    kind = named.schema["row"].dataType.simpleString()
    return named.mapInArrow(_decode(tokenizer_path), f"row {kind}, text STRING").withColumnRenamed("row", id_col)


def _digests(path: str, name: str):
    def digests(batches):
        coder = _coder(path, name)
        sha = lambda texts: pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())
        for batch in small_batches(batches, most=4 << 20):
            ids, ends = coder.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.diff(ends), pa.int64()), sha(coder.decimal(ids, ends)), sha(coder.decode(ids, ends))], names=["row", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digests


def round_trip_digests(docs: DataFrame, tokenizer_path: str, lexicon: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass, of which only digests leave the worker.

    One row per row of ``docs``, repeated ones and null ids too. Null texts count as empty: no
    tokens, and the digests of the empty string. Texts are encoded whole, however long. Columns of
    other names are not read, whatever they are. An empty table gives no rows.
    """
    lexicon = lexicon or build_lexicon(docs, tokenizer_path, text_col=text_col)
    named = docs.select(F.col(id_col).alias("row"), whole_text(text_col).alias("text"))
    kind = named.schema["row"].dataType.simpleString()
    schema = f"row {kind}, n_tokens BIGINT, ids_sha256 STRING, decoded_sha256 STRING"
    return named.mapInArrow(_digests(tokenizer_path, lexicon), schema).withColumnRenamed("row", id_col)


def op10_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))
