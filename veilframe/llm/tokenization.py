"""Token ids of whole texts by the public tokenizers, each distinct chunk of a worker segmented once."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

#: Chunks as written, and words in lower case, that a worker remembers (about 200 bytes each); words longer than LONG,
#: which rarely recur, are not among them. A full table starts afresh.
MAX_CHUNKS, MAX_WORDS, LONG = 300_000, 500_000, 11


def forget(known: dict, most: int = MAX_CHUNKS) -> None:
    """Keep a worker's table bounded."""
    if len(known) > most:
        known.clear()


class WordBpe:
    """Ids by a tokenizers file whose pre-tokens hold no white space and whose normalizer works within words.

    Such a file gives the ids of a text as those of its white-space-separated chunks one after another. Chunks of Latin
    letters are one pre-token each, and so is a run of marks that ends them: new words go to the library's model many at
    a time in lower case, where ids that end a word tell them apart. Other chunks go to the library as they are, and
    so do whole texts that hold a separator which the library takes for a symbol, or an added token's string.
    """

    marks = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # all of ASCII but the apostrophe, which can begin a pre-token of letters
    letters = re.compile(f"[A-Za-zÀ-ÖØ-öø-ÿ]+[{re.escape(marks)}]*")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.symbols = ["\x1c", "\x1d", "\x1e", "\x1f", *added]
        end = self.library.model.end_of_word_suffix
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if end and t.endswith(end)]] = True
        self.known: dict[str, bytes] = {}
        self.ids: dict[str, bytes] = {}
        self.ends_of = lru_cache(10_000)(self._whole)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, chunks: list[str]) -> None:
        split = {c: c.rstrip(self.marks).lower() for c in chunks if self.letters.fullmatch(c)} if self.ends.any() else {}
        other = [c for c in chunks if c not in split]
        forget(self.ids, MAX_WORDS)
        words = list(set(split.values()).difference(self.ids))
        ids: dict[str, bytes] = {}
        parts = [words[i : i + 2000] for i in range(0, len(words), 2000)]
        for part, found in zip(parts, self.words.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            row = np.array(found.ids, "<u4")
            cuts = ((np.flatnonzero(self.ends[row]) + 1) * 4).tolist()
            if len(cuts) != len(part):
                raise ValueError("the tokenizer's words don't end where they should")
            data = row.tobytes()
            ids.update((w, data[a:b]) for w, a, b in zip(part, [0, *cuts], cuts, strict=False))
        for chunk, word in split.items():
            own = ids.get(word) or self.ids[word]
            self.known[chunk] = own + self.ends_of(chunk[len(word) :]) if len(chunk) > len(word) else own
        self.ids.update((w, x) for w, x in ids.items() if len(w) <= LONG)
        for chunk, found in zip(other, self.library.encode_batch_fast(other, add_special_tokens=False) if other else (), strict=True):
            self.known[chunk] = np.array(found.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit integers."""
        split = [None if any(x in t for x in self.symbols) else t.split() for t in texts]
        forget(self.known)
        known, new = self.known, set()
        for words in split:
            new.update(words or ())
        self._learn([w for w in new if w not in known])
        return [self._whole(t) if w is None else b"".join(map(known.__getitem__, w)) for t, w in zip(texts, split, strict=True)]


class Pieces:
    """Ids and decoded text by a sentencepiece file, through a table of distinct marked words.

    A chunk is a run of spaces and the characters up to the next one. Where no piece of the vocabulary has a marker
    after another character and the normalizer leaves texts as they are, no merge crosses a chunk's start, so a text's
    ids are those of its chunks in their order. Other files take the library's path for whole texts.
    """

    chunk = re.compile(" +[^ ]*")

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.library.id_to_piece, range(self.library.get_piece_size()))
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces) and self._plain()
        one = self.library.encode(["x", "x "], num_threads=1)
        self.known: dict[str, list[int]] = {}
        self.blank = one[1][len(one[0]) :]  # a marker alone: the library has no text that gives it by itself

    def _plain(self) -> bool:
        """Whether the file's normalizer is the identity with a leading marker, seen from what it does to spaces and letters."""
        return all(self.library.decode(self.library.encode(s)) == s for s in (" a  b ", "a b", "ﬁ Å é", "\t\n　x"))

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.apart:
            return self.library.encode(texts, num_threads=1)
        forget(self.known)
        self.known[" "] = self.blank
        known, whole = self.known, [t for t in texts if "▁" in t or "\x00" in t]
        direct = dict(zip(whole, self.library.encode(whole, num_threads=1), strict=True)) if whole else {}
        split = [() if t in direct or not t else self.chunk.findall(" " + t) for t in texts]
        fresh = set()
        for words in split:
            fresh.update(words)
        new = [c for c in fresh if c not in known]
        for chunk, ids in zip(new, self.library.encode([c[1:] for c in new], num_threads=1) if new else (), strict=True):
            known[chunk] = ids
        return [direct[t] if t in direct else list(chain.from_iterable(map(known.__getitem__, words))) for t, words in zip(texts, split, strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids) if ids else []


@lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)
