"""Byte-pair encoding with a trie of distinct words, and decoding.

Of a text's prefix only the last token is remembered: it is the only token that ends there such that it may follow the
last token of what comes before it. Two tokens may follow each other if merging their characters by rank gives the two
back; a sequence of tokens is the one that the merges produce if and only if each neighbouring pair is. So the distinct
words of a batch go into a trie, a depth-first walk carries the last tokens from parent to child, and a prefix shared by
many words is worked out once. The tokens of a word are read off by stepping back from its end.

Words of tokenizers with an end mark end in a letter of their own (the letter and the mark), which hangs as a leaf on
the prefix before it.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from siftlake.llm.common import gathered, text_batches
from siftlake.llm.encoder import PLAIN, PLAIN_SPLIT, WORD_END_SPLIT, byte_letters, pieces

#: Pieces, and pairs of tokens, that a worker remembers before it starts anew; bounds its memory.
REMEMBERED = 400_000
#: Characters whose new words go into one trie.
TOGETHER = 8_000_000

ENCODED_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class TrieBpe:
    """Byte-pair encoding of words, many at a time."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str) -> None:
        self.end = end
        self.tokens = {i: t for t, i in vocabulary.items()}
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(merges)}
        #: The two parts that a token is merged from, and the rank of that merge; letters have none.
        self.parts = {a + b: (a, b, rank) for (a, b), rank in reversed(self.ranks.items())}
        if len(self.parts) < len(self.ranks):
            raise ValueError("some token is made by two merges")
        #: Tokens without and with the end mark by their bare text, and all beginnings of either (-1: no token).
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for token, i in vocabulary.items():
            last = end and token.endswith(end) and len(token) > len(end)
            bare = token[: -len(end)] if last else token
            (self.final if last else self.inner)[bare] = i
        for known in (self.inner, self.final):
            for bare, i in known.items():
                if self.merged(self.letters(self.tokens[i])) != [self.tokens[i]]:
                    known[bare] = -1  # its own letters merge to something else: it never comes out
        for bare in [*self.inner, *self.final]:
            for size in range(1, len(bare)):
                self.inner.setdefault(bare[:size], -1)
        self.fits: dict[int, bool] = {}

    def letters(self, token: str) -> list[str]:
        """The letters of a token; its end mark belongs to the last one."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            bare = token[: -len(self.end)]
            return [*bare[:-1], bare[-1] + self.end]
        return list(token)

    def merged(self, parts: list[str]) -> list[str]:
        """The parts after all merges by rank, the leftmost first among equals."""
        while len(parts) > 1:
            ranks = [self.ranks.get(pair, 1 << 60) for pair in zip(parts, parts[1:], strict=False)]
            at = ranks.index(min(ranks))
            if ranks[at] == 1 << 60:
                break
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
        return parts

    def _follows(self, left: int, right: int) -> bool:
        """Whether the letters of the two merge to just the two.

        Undoes the later of the two last merges, again and again; what then touches across the border would have been
        merged if that came before the merge undone (or at its rank, further to the left).
        """
        a, b, before = self.tokens[left], self.tokens[right], 1 << 60
        while True:
            across = self.ranks.get((a, b))
            if across is not None and across < before:
                return False
            of_a, of_b = self.parts.get(a), self.parts.get(b)
            if of_a and (not of_b or of_a[2] > of_b[2]):
                a, before = of_a[1], of_a[2]
            elif of_b:
                b, before = of_b[0], of_b[2] + 1
            else:
                return True

    def _last(self, text: str, starts: list[int], ids: list, ends: dict[str, int]) -> tuple[int, int, list[int]]:
        """The last token of the text, its letters, and the starts at which longer tokens may still begin."""
        going, token, size, depth = [], -1, 0, len(text)
        for start in starts:
            here = ends.get(text[start:])
            if here is None:
                continue
            going.append(start)
            if token < 0 <= here:
                before = ids[start]
                if before is None:
                    token, size = here, depth
                    continue
                pair = before << 32 | here
                fits = self.fits.get(pair)
                if fits is None:
                    if len(self.fits) > REMEMBERED:
                        self.fits.clear()
                    fits = self.fits[pair] = self._follows(before, here)
                if fits:
                    token, size = here, depth - start
        if token < 0:
            raise ValueError(f"the vocabulary has no letter for the end of {text!r}")
        return token, size, going

    def encode(self, words: list[str]) -> dict[str, list[int]]:
        """The ids of each distinct non-empty word."""
        root: dict = {}
        for word in words:
            node = root
            for letter in word[:-1] if self.end else word:
                child = node.get(letter)
                if child is None:
                    child = node[letter] = {}
                node = child
            node.setdefault("", []).append(word)
        found: dict[str, list[int]] = {}
        ids: list[int | None] = [None]  # by depth: the last token of the prefix, its letters, where tokens may go on
        sizes, starts = [0], [[]]
        stack = [(root, "", 0)]
        inner, final = self.inner, self.final
        while stack:
            node, prefix, depth = stack.pop()
            if depth:
                del ids[depth:], sizes[depth:], starts[depth:]
                token, size, going = self._last(prefix, [*starts[-1], depth - 1], ids, inner)
                ids.append(token)
                sizes.append(size)
                starts.append(going)
            for word in node.get("", ()):
                if self.end:
                    token, size, _ = self._last(word, [*starts[depth], depth], ids, final)
                    at, own = depth + 1 - size, [token]
                else:
                    at, own = depth, []
                while at:
                    own.append(ids[at])
                    at -= sizes[at]
                found[word] = own[::-1]
            for letter, child in node.items():
                if letter:
                    stack.append((child, prefix + letter, depth + 1))
        return found


class Codec:
    """Encodes and decodes texts with the file of a byte-level tokenizer with word ends that drops white space."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)  # for the normal form and the split of unusual pieces
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        model = parts["model"]
        split = [x.get("pattern", {}).get("Regex") for x in parts["pre_tokenizer"]["pretokenizers"]]
        if split[:1] != [WORD_END_SPLIT] or parts["decoder"] is not None:
            raise ValueError(f"{path} is not a byte-level tokenizer with word ends")
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.bpe = TrieBpe(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {x["content"]: x["id"] for x in parts["added_tokens"]}
        self.letters = byte_letters()
        self.texts = self.bpe.tokens | {i: t for t, i in self.special.items()}
        self.known: dict[str, tuple[str, int, str]] = {}
        self.words: dict[str, list[int]] = {}

    def _split(self, piece: str) -> list[str | int]:
        """The words of a piece in byte letters, and the ids of the special tokens in it."""
        if PLAIN.fullmatch(piece) and "<|" not in piece:
            words = PLAIN_SPLIT.findall(piece.lower())
            return [w if w.isascii() else "".join([self.letters[b] for b in w.encode()]) for w in words]
        found: list[str | int] = []
        while piece:
            at, special = min(((piece.find(s), s) for s in self.special if s in piece), default=(len(piece), ""))
            normal = self.library.normalizer.normalize_str(piece[:at])
            found += [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal) if w]
            if special:
                found.append(self.special[special])
            piece = piece[at + len(special) :]
        return found

    def learn(self, texts: list[str]) -> None:
        """Work out the pieces of these texts that are not known; the more texts at once, the more prefixes they share."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.words.clear()
        known, new = self.known, set()
        for text in texts:
            new.update([p for p in pieces(text) if p not in known])
        split = {piece: self._split(piece) for piece in new}
        ids = self.words
        ids.update(self.bpe.encode(sorted({w for own in split.values() for w in own if isinstance(w, str) and w not in ids})))
        for piece, own in split.items():
            tokens = [i for w in own for i in (ids[w] if isinstance(w, str) else (w,))]
            known[piece] = (" ".join(map(str, tokens)), len(tokens), self.decode(tokens))

    def decode(self, ids: list[int]) -> str:
        """The texts of the tokens, special ones too, with blanks between, as the library does without a decoder."""
        return " ".join([self.texts[i] for i in ids])

    def encode(self, text: str) -> list[tuple[str, int, str]]:
        """The pieces of a learnt text that have tokens: decimal ids, how many, and the decoded text."""
        return [x for x in map(self.known.__getitem__, pieces(text)) if x[1]]


@functools.cache
def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    return Codec(path)


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, and the SHA-256 of its decimal ids and of its decoded text.

    A null or empty text has no token, and both digests are those of the empty text. Equal rows give equal rows; a null
    doc_id is passed on; an empty table gives no rows. Other columns are ignored.
    """
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer)
        for doc_ids, texts in gathered(batches, TOGETHER):
            coder.learn(texts)
            counts, ids, decoded = [], [], []
            for text in texts:
                own = coder.encode(text)
                counts.append(sum([x[1] for x in own]))
                ids.append(sha256(" ".join([x[0] for x in own]).encode()).hexdigest())
                decoded.append(sha256(" ".join([x[2] for x in own]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)],
                names=[x.split()[0] for x in ENCODED_SCHEMA.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED_SCHEMA)
