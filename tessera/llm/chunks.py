"""Token ids of texts through bounded memos of chunks and words.

For a tokenizer that turns white space into single spaces and then drops them before
merging, no token crosses white space: a text's ids are its chunks' ids in a row, a
chunk's ids are its words' ids in a row. The library encodes each word once while the
memo holds it, many words in a call; results equal the library's on the whole text.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Chunks and words held by a worker at most; then the memo starts anew.
MEMO_CHUNKS = 900_000
MEMO_WORDS = 900_000
_ENCODERS: dict[tuple[str, int], "ChunkEncoder"] = {}

# Up to U+024F the letters and numbers of Unicode are these, and lower case needs no context.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_PLAIN = re.compile("[\x21-\x7e¡-ɏ]+").fullmatch
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+").findall
#: The split that ``_WORDS`` follows; other tokenizers are left to the library.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def drops_white_space(config: dict) -> bool:
    """Whether the tokenizer's own configuration makes white space a hard border."""
    steps = (config.get("normalizer") or {}).get("normalizers", [])
    split = next(iter((config.get("pre_tokenizer") or {}).get("pretokenizers", [])), {})
    return (
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} in steps
        and [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and split.get("invert") is True
        and split.get("pattern", {}).get("Regex", "") == SPLIT
        and bool(config["model"].get("end_of_word_suffix"))
        and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["content"].split() != [t["content"]] for t in config["added_tokens"])
    )


class ChunkEncoder:
    def __init__(self, path: str, memo_chunks: int = MEMO_CHUNKS, memo_words: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.by_chunk = drops_white_space(config)
        self.mark = re.compile("[" + re.escape("".join({t["content"][0] for t in config["added_tokens"]})) + "]").search
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        if self.by_chunk:
            ending = config["model"]["end_of_word_suffix"]
            self.ends_word = np.zeros(size, bool)
            self.ends_word[[i for t, i in config["model"]["vocab"].items() if t.endswith(ending)]] = True
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.memo_chunks, self.memo_words = memo_chunks, memo_words

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[str]) -> None:
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=self.kind)
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * self.kind.itemsize
            if len(ends) == len(part):
                raw, at = ids.tobytes(), [0, *ends.tolist()]
                self.words.update(zip(part, [raw[a:b] for a, b in zip(at, at[1:])], strict=True))
            else:
                self.words.update(zip(part, self._library(part), strict=True))

    def _learn(self, chunks: list[str]) -> None:
        memo = self.memo
        plain, cut = [], []
        for c in chunks:
            if _PLAIN(c):
                low = c.lower()
                if low.isalpha():  # one word
                    plain.append(c)
                    cut.append((low,))
                elif not self.mark(c):  # a special token needs its first character
                    plain.append(c)
                    cut.append(_WORDS(low))
        known = self.words
        new = {w for ws in cut for w in ws if w not in known}
        if len(known) + len(new) > self.memo_words:  # words in use stay
            self.words = known = {w: known[w] for ws in cut for w in ws if w in known}
        self._learn_words(list(new))
        get = known.__getitem__
        memo.update(zip(plain, [b"".join(map(get, ws)) for ws in cut], strict=True))
        other = [c for c in chunks if c not in memo]
        memo.update(zip(other, self._library(other), strict=True))

    def _values(self, chunks: list[str]) -> list[bytes]:
        """Each chunk's ids."""
        got = list(map(self.memo.get, chunks))
        new = [c for c, g in zip(chunks, got, strict=True) if g is None]
        if len(self.memo) + len(new) > self.memo_chunks:  # chunks in use stay
            self.memo = {c: g for c, g in zip(chunks, got, strict=True) if g is not None}
        self._learn(new)
        get = self.memo.__getitem__
        return [get(c) if g is None else g for c, g in zip(chunks, got, strict=True)]

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow array's texts in a row, and where each text's begin (one more for the end)."""
        from tessera.llm import pieces

        if not self.by_chunk:
            ids = self._library([t or "" for t in column.to_pylist()])
            return pieces.gather(ids, np.arange(len(ids)), np.arange(len(ids) + 1), self.kind)
        chunks, first = pieces.split_at_space(column)
        values, places = pieces.distinct(chunks)
        return pieces.gather(self._values(values), places, first, self.kind)


def encoder(path: str) -> ChunkEncoder:
    """The worker's own encoder for ``path``, kept from task to task."""
    key = (path, os.getpid())
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path)
    return _ENCODERS[key]


def small_batches(batches, text: str = "text", most: int = 8 << 20):
    """Cuts record batches so that each holds about ``most`` bytes of text, or one row."""
    for batch in batches:
        rows, size = batch.num_rows, batch.column(batch.schema.get_field_index(text)).nbytes
        step = max(1, rows * most // max(size, 1))
        for k in range(0, rows, step):
            yield batch.slice(k, step)
