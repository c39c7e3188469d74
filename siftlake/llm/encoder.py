"""Token ids of whole texts through the tokenizers library, which sees each blank-separated piece once per worker."""

from __future__ import annotations

import functools
import json
import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siftlake.llm.common import BLANKS, ranges

#: Pieces that a worker remembers before it starts anew; bounds its memory.
REMEMBERED = 800_000

#: Letters and digits of the plain alphabet: ASCII, Latin-1 and Latin Extended-A without the dotted capital I, whose
#: lower case has a combining mark. These letters are in normal form C and their lower case is one letter.
LETTERS, DIGITS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
PLAIN = re.compile("[!-~\xa1-\u012f\u0131-\u017f]+")
#: The split of tokenizers with word ends, for pieces of the plain alphabet in lower case.
WORD_END_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"  # fixed: as in the tokenizer file
PLAIN_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{LETTERS}{DIGITS}]+")


def byte_letters() -> list[str]:
    """The printable character that byte-level tokenizers write for each byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def pieces(text: str) -> list[str]:
    """The text cut at ASCII blanks. No token of a tokenizer that drops white space spans a cut."""
    for blank in BLANKS[1:]:
        if blank in text:
            text = text.replace(blank, " ")
    return text.split(" ")


class PieceEncoder:
    """Ids of texts, put together from the ids of their pieces.

    Only for tokenizers whose pre-tokenizer drops white space and never joins what it separates; each piece is
    encoded by the library itself, special tokens in the text included.
    """

    def __init__(self, path: str, end_id: int | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.end_id = end_id
        parts = json.loads(self.tokenizer.to_str())
        split = [x.get("pattern", {}).get("Regex") for x in (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        steps = [x["type"] for x in (parts.get("normalizer") or {}).get("normalizers", [])]
        self.word_ends = split[:1] == [WORD_END_SPLIT] and steps == ["NFC", "Replace", "Lowercase"]
        special = [re.escape(x["content"]) for x in parts["added_tokens"]]
        self.special = re.compile("|".join(special) or r"(?!)")
        self.letters = byte_letters()
        self._forget()

    def _forget(self) -> None:
        end = [] if self.end_id is None else [self.end_id]
        self.index: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), len(end)
        self.flat[: len(end)] = end
        self.starts, self.lengths, self.known = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 1
        self.lengths[0] = len(end)  # entry 0 closes each text

    def _ids(self, new: list[str]) -> list[list[int]]:
        """The library's ids of each piece. Plain pieces are normalised and split here and go to its model directly."""
        plain = [self.word_ends and PLAIN.fullmatch(x) is not None and not self.special.search(x) for x in new]
        rest = iter(self.tokenizer.encode_batch_fast([x for x, p in zip(new, plain, strict=True) if not p], add_special_tokens=False))
        model, known, ids = self.tokenizer.model, {}, []
        for piece, is_plain in zip(new, plain, strict=True):
            if not is_plain:
                ids.append(next(rest).ids)
                continue
            own = []
            for word in PLAIN_SPLIT.findall(piece.lower()):
                found = known.get(word)
                if found is None:
                    written = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
                    found = known[word] = [x.id for x in model.tokenize(written)]
                own += found
            ids.append(own)
        return ids

    def _learn(self, new: list[str]) -> np.ndarray:
        """Add new pieces; their entries."""
        ids = self._ids(new)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        total, known = int(lengths.sum()), self.known + len(new)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while known > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.flat[self.used : self.used + total] = np.fromiter((x for row in ids for x in row), np.uint32, total)
        self.starts[self.known : known] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.known : known] = lengths
        self.index.update(zip(new, range(self.known, known), strict=True))
        entries = np.arange(self.known, known)
        self.used, self.known = self.used + total, known
        return entries

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids as one uint32 array, and the offsets of the texts in it (one more than texts)."""
        if self.known > REMEMBERED:
            self._forget()
        split = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        counts = np.diff(split.offsets.to_numpy()).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(known < 0)
        if len(missing):
            known[missing] = self._learn([words[i] for i in missing.tolist()])
        at = known[coded.indices.to_numpy()]
        at = np.insert(at, np.cumsum(counts), 0)  # the end of each text
        lengths = self.lengths[at]
        ids = self.flat[ranges(self.starts[at], lengths)]
        ends = np.cumsum(lengths)[np.cumsum(counts + 1) - 1] if len(texts) else np.zeros(0, np.int64)
        return ids, np.concatenate([[0], ends]).astype(np.int64)


@functools.cache
def encoder(path: str, end_id: int | None) -> PieceEncoder:
    """One encoder per worker process, file and end id."""
    return PieceEncoder(path, end_id)
