"""Whole-text encoding with a public tokenizer file, through a bounded cache of words.

The tokenizer drops white space and never merges across it, so the ids of a text are
those of its words in turn. Words are cut at ASCII blanks and dictionary-encoded by
Arrow; each distinct word is encoded once while the cache holds it, and a word that has
other blanks inside goes through the whole tokenizer like any odd one.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

SPECIAL = "<|startoftext|>"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def largest_id(path: str) -> int:
    """The greatest id that the tokenizer file can give, added tokens included."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    vocabulary = whole["model"]["vocab"]
    ids = vocabulary.values() if isinstance(vocabulary, dict) else range(len(vocabulary))
    return max([0, *ids, *(t["id"] for t in whole.get("added_tokens") or [])])


class WordCodec:
    """Ids of texts by ``tokenizers``, ``add_special_tokens=False``, as flat arrays."""

    def __init__(self, path: str, limit: int = 450_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # the same model behind a plain blank splitter, for words known to be normalised letters
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.limit = limit
        self.mark = self.whole.token_to_id(SPECIAL)
        self.kind = np.uint16 if self.whole.get_vocab_size() <= 65536 else np.uint32
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        self.ends[[i for t, i in self.whole.get_vocab().items() if t.endswith("</w>")]] = True
        self.tails = {c: int(self.ids(c)[0]) for c in ".,"}
        self.reset()

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=self.kind)

    def reset(self) -> None:
        self.code: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, self.kind), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.hits = np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Keep the words that came most often, at most half of the limit: words seen once go."""
        least = max(2, int(np.partition(self.hits, len(self.hits) - self.limit // 2)[len(self.hits) - self.limit // 2]) + 1)
        kept = np.flatnonzero(self.hits >= least)
        words = np.array(list(self.code), dtype=object)[kept].tolist()  # codes are in order of insertion
        size = self.size[kept]
        end = np.cumsum(size, dtype=np.int64)
        at = np.repeat(self.start[kept] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)
        self.flat, self.start, self.size, self.hits = self.flat[at], (end - size).astype(np.int32), size, np.ones(len(kept), np.int32)
        self.code = dict(zip(words, range(len(words))))

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_each`` for words of letters: each ends at its one id with the end-of-word suffix."""
        flat, sizes = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 4000):
            part = words[i : i + 4000]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=self.kind)
            cut = np.flatnonzero(self.ends[ids])
            if len(cut) != len(part) or cut[-1] != len(ids) - 1:
                return self._each(self.whole, words)
            flat.append(ids)
            sizes.append(np.diff(cut, prepend=-1))
        return np.concatenate(flat), np.concatenate(sizes)

    def _each(self, tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in turn, number of ids of each word): encoded together around a mark that no text can merge with."""
        flat, sizes = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 4000):
            part = words[i : i + 4000]
            ids = np.array(tokenizer.encode_batch_fast([SPECIAL.join(part)], add_special_tokens=False)[0].ids, dtype=self.kind)
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) != len(part) - 1:  # a word holds the mark itself
                own = [self.ids(w) for w in part]
                flat += own
                sizes.append(np.fromiter(map(len, own), np.int64, len(own)))
            else:
                flat.append(ids[ids != self.mark])
                sizes.append(np.diff(cut, prepend=-1, append=len(ids)) - 1)
        return np.concatenate(flat), np.concatenate(sizes)

    def _learn(self, words: list[str]) -> None:
        cores: dict[str, int] = {}
        near, tail, rest, order = [], [], [], []
        # plain ASCII words, at most one stop or comma after their letters, in bulk
        w = pa.array(words, pa.string())
        ends = pc.or_(pc.ends_with(w, "."), pc.ends_with(w, ","))
        core = pc.if_else(ends, pc.utf8_slice_codeunits(w, 0, -1), w)
        easy = np.asarray(pc.and_(pc.string_is_ascii(w), pc.ascii_is_alpha(core)))
        at = np.flatnonzero(easy)
        low = pc.ascii_lower(core.take(pa.array(at))).dictionary_encode()
        cores.update((x, i) for i, x in enumerate(low.dictionary.to_pylist()))
        stop, comma = (np.asarray(pc.ends_with(w, c))[at] for c in ".,")
        marks = np.select([stop, comma], [self.tails["."], self.tails[","]], -1)
        order += [words[i] for i in at.tolist()]
        tails, put = self.tails, cores.setdefault
        for i in np.flatnonzero(~easy).tolist():
            x = words[i]
            # a letter before the last stop or comma: both are encoded apart
            t = tails.get(x[-1:], -1)
            s = (x if t < 0 else x[:-1]).lower()
            # lower() may change the number of letters; such words go the long way
            if s.isalpha() and len(s) == len(x) - (t >= 0) and "ς" not in s and "σ" not in s and unicodedata.is_normalized("NFC", s):
                near.append(put(s, len(cores)))
                tail.append(t)
                order.append(x)
            else:
                rest.append(x)
        flat, sizes = self._letters(list(cores))
        near = np.concatenate([np.asarray(low.indices).astype(np.int64), np.array(near, np.int64)])
        tail = np.concatenate([marks.astype(np.int64), np.array(tail, np.int64)])
        first, own = (np.cumsum(sizes) - sizes)[near], sizes[near]
        size = own + (tail >= 0)
        end = np.cumsum(size)
        at = np.repeat(first - (end - size), size) + np.arange(int(size.sum()))
        ids = flat[np.minimum(at, max(0, len(flat) - 1))] if len(flat) else flat
        ids[(end - 1)[tail >= 0]] = tail[tail >= 0]
        odd, odd_size = self._each(self.whole, rest)
        size = np.concatenate([size, odd_size])
        self.start = np.concatenate([self.start, (len(self.flat) + np.cumsum(size) - size).astype(np.int32)])
        self.size = np.concatenate([self.size, size.astype(np.int32)])
        self.hits = np.concatenate([self.hits, np.zeros(len(size), np.int32)])
        self.flat = np.concatenate([self.flat, ids, odd])
        base = len(self.code)
        self.code.update(zip(order + rest, range(base, base + len(words))))

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in turn, number of ids of each text)."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        parts = pc.ascii_split_whitespace(texts)
        words = parts.flatten().dictionary_encode()
        n_words = np.asarray(pc.list_value_length(parts)).astype(np.int64)
        seen = words.dictionary.to_pylist()
        if len(self.code) > self.limit:
            self._forget()
        if new := [w for w in seen if w not in self.code]:
            self._learn(new)
        code = np.fromiter(map(self.code.__getitem__, seen), np.int32, len(seen))
        self.hits[code] += 1
        # 32 bits hold any place: a batch of texts and the cache are each far below 2 GB
        at = code[np.asarray(words.indices)]
        size = self.size[at]
        end = np.cumsum(size, dtype=np.int64)
        total = int(end[-1]) if len(end) else 0
        from_to = np.repeat(self.start[at] - (end - size).astype(np.int32), size)
        from_to += np.arange(total, dtype=np.int32)
        return self.flat[from_to], np.diff(np.concatenate([[0], end])[np.cumsum(n_words)], prepend=0)


def codec(path: str) -> WordCodec:
    """This worker's codec, kept from task to task."""
    return common.held(f"codec {path}", lambda: WordCodec(path))
